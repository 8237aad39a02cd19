"""Collectibles market analytics on Spark: operators."""
