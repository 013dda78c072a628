"""Operators: DataFrames in, DataFrames out. None of them collects rows to the driver."""
