"""Spark-native mining and analytics operators."""
