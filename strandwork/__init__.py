"""Spark-native analytics for DNA methylation data and for training corpora."""
