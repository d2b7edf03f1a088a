"""Temporal checks over recorded traces, verdict scoring and training-data curation on Spark."""
