"""Tile analytics on Spark: map-tile pyramids and the work around them as ordinary DataFrame jobs."""
