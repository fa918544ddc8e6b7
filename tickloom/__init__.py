"""Tick-data research on Spark DataFrames."""
