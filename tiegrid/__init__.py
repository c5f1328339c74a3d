"""Catalog, tie-point and raster analytics on Spark."""
