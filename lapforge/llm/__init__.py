"""Training-data operators: deduplication, decontamination, scoring, mixing, formatting.

Nothing outside this subpackage imports it.
"""
