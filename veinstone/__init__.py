"""Spark-native evidence analytics: chunking, claim extraction, resolution, retrieval, evaluation."""
