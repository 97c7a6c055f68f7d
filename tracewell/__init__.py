"""Healthy-reference analytics over recordings, profiles and design curves, on Spark DataFrames."""

__version__ = "0.1.0"
