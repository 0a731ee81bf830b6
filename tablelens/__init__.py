"""Automatic table analysis on Spark DataFrames."""
