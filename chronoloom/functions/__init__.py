"""Column builders: clocks, labels, coercions, formatting and parsing. No Python runs on the executors."""
