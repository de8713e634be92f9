"""Spark-native engine for page records: extraction, normalisation and analytics."""

__version__ = "0.1.0"
