"""Spark-native provenance, validation and as-of-feature engine."""
