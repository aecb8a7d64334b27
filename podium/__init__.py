"""Ranked-list (chart) analytics on Spark: operators are functions from DataFrames to DataFrames."""
