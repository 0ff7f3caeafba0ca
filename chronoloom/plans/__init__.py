"""Schemas and catalog views compiled from a trace's metadata."""
