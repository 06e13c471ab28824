"""Operators for large-scale training-data pipelines.

Every operator takes and returns DataFrames.  Nothing outside this package
imports it.
"""
