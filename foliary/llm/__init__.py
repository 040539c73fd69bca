"""Training-data operators: deduplication, filtering, sharding and tokenising of text corpora.

Nothing outside this subpackage imports it.
"""
