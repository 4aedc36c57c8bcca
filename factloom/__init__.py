"""Spark-first operators for mining facts, statistics and structure from tables."""
