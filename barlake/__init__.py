"""Spark-first analytics over event-level trade data."""
