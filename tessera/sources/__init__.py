"""Collectibles market analytics on Spark: sources."""
