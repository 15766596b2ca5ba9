"""Comparison of two versions of a keyed collection, as Spark DataFrames."""
