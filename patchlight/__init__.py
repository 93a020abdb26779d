"""Labelling and review of source-code changes as PySpark jobs."""
