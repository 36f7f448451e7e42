"""Spark-native retrieval analytics: corpus build, search, fusion, graphs and evaluation as DataFrames."""
