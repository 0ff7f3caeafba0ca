"""Operators on event DataFrames, as plans that Catalyst optimizes."""
