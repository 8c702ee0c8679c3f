"""Tabular analysis and preparation operators on Spark DataFrames."""
