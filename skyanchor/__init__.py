"""Geo-registration analytics on Spark: retrieval, pose, quality, sequences and evaluation as DataFrames."""

__version__ = "0.1.0"
