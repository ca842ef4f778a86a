"""Spark-native code retrieval and failure diagnosis."""

__version__ = "0.1.0"
