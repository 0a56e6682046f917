"""Spark-native analytics over point observations and their entity labels."""
