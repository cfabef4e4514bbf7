"""Spark-native document structuring: every operator is a DataFrame -> DataFrame function."""
