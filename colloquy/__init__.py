"""Spark-native evidence analytics over recorded discussions."""
