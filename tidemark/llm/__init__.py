"""Operators that prepare training data: quality, duplicates, mixing, packing, search."""
