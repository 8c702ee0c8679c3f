"""Operators for preparing training text: fingerprints, token files, deduplication, search, scoring, mixing, packing."""
