"""Spark-native operators for building, measuring and querying text corpora."""
