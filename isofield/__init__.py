"""Sparse-grid and level-set analytics on Spark DataFrames."""
