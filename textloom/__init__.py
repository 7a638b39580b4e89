"""Spark-native text corpus indexing and hybrid retrieval."""
