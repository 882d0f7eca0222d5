"""Spark-first analytics over representation trials, record streams and training corpora."""

__version__ = "0.1.0"
