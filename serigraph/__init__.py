"""Symbolic analysis of time-series panels with Spark DataFrames."""
