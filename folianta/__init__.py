"""Folianta: search, comparison and audit of text collections as Spark jobs."""

__version__ = "0.1.0"
