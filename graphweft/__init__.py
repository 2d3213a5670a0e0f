"""Spark-native analytics over property graphs, event logs and text."""
