"""Spark-first analytics over document corpora."""

__version__ = "0.1.0"
