"""Spark-native analytics for multi-source financial ledgers and text corpora."""
