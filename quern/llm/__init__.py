"""Operators for large text corpora: tokens, deduplication, search, quality, archives, extraction and mixing."""
