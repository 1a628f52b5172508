"""Raster segmentation and per-segment analytics on Spark DataFrames."""
