"""Spatial-access and site-activity analytics on Spark DataFrames."""
