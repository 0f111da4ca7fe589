"""Spark-native analytics for infrastructure-threat research."""
