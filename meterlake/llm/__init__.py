"""Operators of a training-data pipeline: classification, filtering, deduplication, mixing, tokens.

Nothing else in the library imports this subpackage.
"""
