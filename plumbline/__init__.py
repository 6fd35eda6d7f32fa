"""Spatial, space-time and network estimation on Spark DataFrames."""
