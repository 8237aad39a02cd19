"""Collectibles market analytics on Spark: plans."""
