"""Spark-native variant annotation, transcript building and corpus preparation."""
