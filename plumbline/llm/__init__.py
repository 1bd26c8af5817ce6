"""Operators for training-data pipelines: de-duplication, packing, mixing, licences, formatting, quality, extraction."""
