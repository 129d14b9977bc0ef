"""Spark-native analytics over infrastructure failures, fixes, plans and tickets."""

__version__ = "0.1.0"
