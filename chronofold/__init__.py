"""Causal time-series analytics on Spark DataFrames."""
