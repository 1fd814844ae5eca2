"""Operators on training text: deduplication, quality, toxicity, secrets, mixing, counting, packing and ordering."""
