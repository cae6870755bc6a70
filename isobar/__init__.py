"""Spark-native entity time-series analytics."""
