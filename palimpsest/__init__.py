"""Spark-native analytics for machine-generated translation text."""

__version__ = "0.1.0"
