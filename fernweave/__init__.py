"""Embedding-based retail analytics on PySpark: DataFrame in, DataFrame out."""
