"""A Spark-native knowledge-base engine: ingest, chunk, resolve, search, traverse and audit a corpus with DataFrames."""

__version__ = "0.1.0"
