"""Operators on DataFrames: clustering, statistics, joins, set operations, parity."""
