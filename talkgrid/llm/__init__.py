"""Operators for preparing text corpora: detection, deduplication, scoring and mixing."""
