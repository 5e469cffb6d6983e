"""Operators for preparing training text: archives, packing, quality, near and exact duplicates, licences, mixing,
toxicity, fingerprints and token files. Nothing outside this package imports it."""
