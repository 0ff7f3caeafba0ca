"""Reading and writing traces: metadata, field classes, decoding, and the Spark data source."""
