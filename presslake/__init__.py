"""Spark-native ingestion, search and statistics for press and social mentions."""
