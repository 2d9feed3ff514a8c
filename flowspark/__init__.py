"""Spark-native analytics for trade ticks and order books."""
