"""Batch retrieval, evaluation and text-corpus jobs on Spark DataFrames."""
