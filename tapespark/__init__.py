"""Spark-native analytics over timestamped trade tapes and evidence tables."""
