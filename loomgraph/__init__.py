"""Spark-native graph memory, hybrid retrieval and recommendation analytics."""
