"""Operators for training-data pipelines: search, filters, near-duplicates, tokens, archives.

Nothing else in the library imports this package. Each module holds one operator with
its own interface; ``queries`` registers the thin ``opN_`` queries over the given tables.
"""
