"""Spark-native analytics over labelled text datasets."""
