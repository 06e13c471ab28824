"""Spark-native analytics for private-credit portfolios and training-data pipelines."""
