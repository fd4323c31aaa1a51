"""Spark-native analytics over labelled multi-sensor recordings."""
