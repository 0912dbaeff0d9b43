"""Spark jobs for large collections of camera-raw video kept as tables."""

__version__ = "0.1.0"
