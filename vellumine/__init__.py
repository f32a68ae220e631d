"""Spark-native analytics for bibliographic and document corpora."""
