"""Functions on source text."""
