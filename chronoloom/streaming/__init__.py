"""Growing traces with Structured Streaming."""
