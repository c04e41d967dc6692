"""Spark-first table preparation, profiling and multi-source alignment."""
