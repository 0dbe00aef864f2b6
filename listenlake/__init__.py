"""Listening-history analytics on Spark DataFrames."""
