"""Heddle: a Spark-native analytics engine whose datasets are named by the computation that produced them."""
