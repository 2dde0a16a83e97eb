"""Training-data operators: mixing, quality, tokenising, extraction, scoring, archives, formatting, dedup.

Each module holds one operator with its own interface; ``queries`` registers
the thin contract queries over the provided tables. Nothing outside this
subpackage imports it.
"""
