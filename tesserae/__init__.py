"""Spark-native analytics over tiled imagery, its metadata and its geometry."""

__version__ = "0.1.0"
