"""Spark-native corpus curation, dataset assembly and evaluation."""
