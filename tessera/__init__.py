"""Spark-native clustering and benchmark analytics."""
