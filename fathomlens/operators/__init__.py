"""Operators: DataFrames (and vocabulary DataFrames) in, DataFrames out."""
