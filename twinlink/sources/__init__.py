"""Scans of entity, pair and record files, and the result and embedding tables."""
