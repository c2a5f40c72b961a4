"""Datasets on storage: layout, logs, writers and readers."""
