"""Spark-native log search and analytics."""
