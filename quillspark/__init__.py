"""Spark-first document and job analytics."""
