"""Spark operators that turn survey polygons and aerial rasters into curated, scored damage maps."""
