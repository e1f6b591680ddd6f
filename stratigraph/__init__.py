"""Spark-native multiscale grouping of embedding vectors and corpus preparation."""

__version__ = "0.1.0"
