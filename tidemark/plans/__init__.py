"""Named plans built from the operators."""
