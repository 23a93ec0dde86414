"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it. Every operator takes DataFrames
with at least the columns it names, ignores further columns (whatever they are
called), and states in its docstring what nulls, empty texts, ties, repeated
rows and empty tables give.
"""
