"""Training-data operators: near duplicates, repeated passages, mixing, extraction, scoring and packing.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` register what it offers.
"""
