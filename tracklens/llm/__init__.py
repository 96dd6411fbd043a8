"""Training-data operators: scoring, sharding, tokenising, packing, search and de-duplication.

Nothing outside this subpackage imports it.
"""
