"""Operators for preparing language-model training data, as Spark jobs.

Each module holds one operator with a general interface (column names and
parameters are arguments) and, below it, the thin registered query.  Nothing
outside this subpackage imports it.
"""
