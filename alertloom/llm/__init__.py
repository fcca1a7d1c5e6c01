"""Operators for large text corpora: search, language, filters, mixing, quality,
archives, binary output, near duplicates and packing.

Nothing outside this folder imports it.
"""
