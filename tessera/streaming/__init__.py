"""Collectibles market analytics on Spark: streaming."""
