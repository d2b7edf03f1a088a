"""Property checks on streams."""
