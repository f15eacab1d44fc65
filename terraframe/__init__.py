"""Spark-native raster-as-table and per-pixel time-series analytics."""
