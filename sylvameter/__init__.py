"""Sylvameter: evidence analytics over very large tables, written on Spark DataFrames."""

__version__ = "0.1.0"
