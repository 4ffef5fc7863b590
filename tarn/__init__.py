"""Spark-native retrieval, advisory and corpus analytics over plain DataFrames."""
