"""Spark-native network resilience analytics; see README.md."""
