"""Spark-native preparation of code and text corpora for model training."""
