"""Spark-native engine for sectioned technical documents: ingestion, retrieval, upkeep and usage data."""
