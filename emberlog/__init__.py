"""Spark-native log and error analytics."""
