"""Spark-native image-codec analytics: every operator is a DataFrame plan."""
