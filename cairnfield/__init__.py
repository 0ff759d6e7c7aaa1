"""Spark-native analytics for captured web responses, host corpora, access logs and experiment sheets."""
