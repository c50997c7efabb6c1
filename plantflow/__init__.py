"""Spark-native analytics over packet tables and large text corpora."""
