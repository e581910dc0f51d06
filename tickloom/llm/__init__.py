"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
plain parameters, and states in its docstring what it returns for nulls, empty
texts, ties, repeated rows, empty tables and clashing column names.
"""
