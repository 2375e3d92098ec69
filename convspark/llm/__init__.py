"""Operators and pipeline stages for large-scale training-data preparation.

Every operator takes and returns DataFrames, one module each; ``queries``
registers the thin ``opN_<name>`` queries over the given tables.  Nothing
outside this folder imports it (``__spark_entry__`` guards its import).
"""
