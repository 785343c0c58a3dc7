"""Tidewater: a Spark-native analytics engine built on DataFrames, SQL and Structured Streaming."""
