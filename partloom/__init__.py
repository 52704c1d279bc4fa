"""Spark-native analytics for engineering-document catalogues and text corpora."""
