"""Spark-native analytics engine for mining terms and concepts from free text."""

__version__ = "0.1.0"
