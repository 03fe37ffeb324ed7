"""Operators of a training-data pipeline: text, duplicates, quality, mixing, tokens, shards."""
