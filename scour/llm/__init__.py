"""Operators that prepare training text: tokenisation, duplicates, privacy, formatting, search, packing, quality.

Nothing else in the library imports this subpackage.
"""
