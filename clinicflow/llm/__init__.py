"""Operators for large text corpora: tokens, filters, duplicates, labels and contamination."""
