"""Raster analytics on Spark: pixels, scenes, labels and patches as DataFrames."""
