"""Spark-native feature preparation and evaluation for tabular data."""
