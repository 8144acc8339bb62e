"""Sextant: retrieval analytics on Spark DataFrames."""
