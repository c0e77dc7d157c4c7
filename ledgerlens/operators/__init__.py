"""Operators: DataFrames and column names in, DataFrame out."""
