"""Append-only, versioned, Hive-partitioned datasets with a change stream, on Spark."""
