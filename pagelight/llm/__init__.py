"""Training-data operators: sharding, decontamination, archives, dedup, filters, tokenizing, search.

Nothing else in the library imports this subpackage.
"""
