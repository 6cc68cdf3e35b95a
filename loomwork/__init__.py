"""Spark-first analytics over outcome-mapping data."""
