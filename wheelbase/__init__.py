"""Catalog cleaning, preference matching and attribute analysis as Spark DataFrame operators."""

__version__ = "0.1.0"
