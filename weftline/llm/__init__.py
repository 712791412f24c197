"""Training-data operators: sharding, tokenizing, dedup, search, classifiers and mixing.

Nothing outside this subpackage imports it.
"""
