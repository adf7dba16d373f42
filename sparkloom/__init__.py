"""Spark-native graph analytics: vertex programs as DataFrame plans."""
