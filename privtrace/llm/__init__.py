"""Operators for training-data pipelines: deduplication, mixing, extraction, tokenizing, quality.

Nothing else in the library imports this subpackage.
"""
