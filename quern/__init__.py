"""Spark-native engine for governed document retrieval and corpus processing."""

__version__ = "0.1.0"
