"""Operators for preparing training text: deduplication, filtering, scoring, mixing, tokens."""
