"""Training-data operators: chat, dedup, decontamination, scoring, mixing and filters.

Nothing else in the library imports this subpackage.
"""
