"""Training-data operators: fingerprints, sharding, near duplicates, tokens, packing.

Nothing outside this subpackage imports it.
"""
