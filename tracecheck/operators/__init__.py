"""Operators on traces, verdicts, attempts, training rows and catalogs."""
