"""Spark-native corpus preparation and retrieval evaluation."""
