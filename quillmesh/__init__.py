"""Spark-native corpus and retrieval analytics."""
