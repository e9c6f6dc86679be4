"""Spark-native consolidation of large file inventories."""
