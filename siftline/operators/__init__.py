"""Operators: DataFrame in, DataFrame (or Column) out."""
