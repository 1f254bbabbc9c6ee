"""Training-data operators: quality, dedup, decontamination, redaction, mixing, formatting.

Nothing else in the library imports this subpackage.
"""
