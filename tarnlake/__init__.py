"""Tarnlake: retrieval and analytics over text collections and file trees, built on PySpark DataFrames."""

__version__ = "0.1.0"
