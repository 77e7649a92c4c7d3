"""Spark-native retrieval analytics: vector, lexical and hybrid search over DataFrames."""
