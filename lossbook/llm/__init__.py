"""Operators that prepare a text corpus: scoring, cleaning, deduplication, search, mixing and token output."""
