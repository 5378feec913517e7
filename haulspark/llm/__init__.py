"""Operators that prepare training data: dedup, mixing, filtering, scoring, tokenising, archiving."""
