"""Operators for preparing text corpora: sharding, near duplicates, archives, filters, search, tokens and mixing.

Nothing else in the library imports this subpackage.
"""
