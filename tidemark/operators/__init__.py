"""Relational operators on DataFrames, without storage."""
