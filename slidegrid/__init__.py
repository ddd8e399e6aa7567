"""Tile-grid image analytics and record processing on Spark DataFrames."""
