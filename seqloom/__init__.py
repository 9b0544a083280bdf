"""Spark-native processing of biological sequence files."""
