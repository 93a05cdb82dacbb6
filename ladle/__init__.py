"""Procedural-graph analytics on Spark DataFrames."""
