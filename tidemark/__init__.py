"""Spark-native high-level event mining."""
