"""Training-data operators: deduplication, filtering, tokenization, packing and search.

Nothing else in the library imports this subpackage.
"""
