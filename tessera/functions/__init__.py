"""Collectibles market analytics on Spark: functions."""
