"""Exact vector search and text embedding on Spark DataFrames."""
