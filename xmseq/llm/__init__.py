"""Operators of a training-data pipeline: near-duplicates, fingerprints, language, scoring, mixing, packing."""
