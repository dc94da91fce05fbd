"""Ranking-data analytics on PySpark: labels, features, splits, metrics and audits as DataFrame operators."""

__version__ = "0.1.0"
