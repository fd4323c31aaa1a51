"""Operators of a training-data pipeline: fingerprints, formatting, mixing, quality, dedup, toxicity, language, packing, PII."""
