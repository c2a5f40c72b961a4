"""Scalar functions: key patterns, keys and offsets, durations, time layouts."""
