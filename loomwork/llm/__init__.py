"""Operators for large text corpora: de-duplication, filtering, tokenising, packing and search."""
