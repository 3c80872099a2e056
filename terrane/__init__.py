"""Spark-native analysis of error-bounded numeric fields."""
