"""Operators for preparing training text: deduplication, archives, tokens, mixing, classifiers, search."""
