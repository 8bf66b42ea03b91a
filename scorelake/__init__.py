"""Spark-first engine for answer-grounded table questions over event data."""
