"""Training-data operators: dedup, search, formatting, filtering, sharding, tokenising.

Nothing else in the library imports this subpackage.
"""
