"""Spark-native linked-data, sequence and search analytics over DataFrames."""
