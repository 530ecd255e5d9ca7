"""Column functions: text normalization and one-edit matching."""
