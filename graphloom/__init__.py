"""Spark-native engine for weighted graph embeddings: graphs, vector spaces, radius joins, layouts, metrics."""

__version__ = "0.1.0"
