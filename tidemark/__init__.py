"""Tidemark: data movement, validation, replication and query operators on PySpark DataFrames."""
