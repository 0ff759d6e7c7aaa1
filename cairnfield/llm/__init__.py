"""Operators for large training-data pipelines (fingerprints, chat formatting, packing, ...)."""
