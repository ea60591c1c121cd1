"""Spark-native retail and service-log analytics: DataFrame, SQL and Structured Streaming jobs."""
