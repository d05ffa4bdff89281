"""Operators of a training-data pipeline: tokens, quality, licenses, duplicates, mixing, packing, language models."""
