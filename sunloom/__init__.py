"""Spark-native analytics over relations of threads, points, pixels and frames."""
