"""Spark-native analytics for obliquely acquired image volumes."""
