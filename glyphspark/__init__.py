"""Spark-native text search, profiling, entity extraction and search-log analytics."""

__version__ = "0.1.0"
