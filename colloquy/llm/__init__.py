"""Training-data operators: tokenising, deduplication, decontamination, archives and filters.

Every operator takes and returns DataFrames. Nothing outside this subpackage imports it.
"""
