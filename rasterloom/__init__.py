"""Raster, shape and table operators on Spark DataFrames."""
