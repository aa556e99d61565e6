"""Spark-native analytics over text memories: graphs, decay, retrieval, fusion and evaluation."""
