"""Ratio models, their data preparation and reports, on Spark DataFrames."""
