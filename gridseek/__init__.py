"""Spark-native grid retrieval, localisation and vector analytics."""
