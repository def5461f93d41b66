"""Spark-native document analytics engine."""
