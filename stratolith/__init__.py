"""Stratolith: a Spark engine for raster, vector and catalogue analytics."""
