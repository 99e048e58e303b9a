"""Operators that a large-scale training-data pipeline needs, on Spark DataFrames."""
