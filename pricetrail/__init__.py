"""Spark operators for dated price observations: DataFrames in, DataFrames out."""
