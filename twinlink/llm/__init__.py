"""Operators of a training-data pipeline: scoring, deduplication, extraction, encoding and decontamination of texts.

Nothing else in the package imports this subpackage.
"""
