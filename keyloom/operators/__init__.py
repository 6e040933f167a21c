"""Operators: each takes DataFrames and returns DataFrames; none collects data."""
