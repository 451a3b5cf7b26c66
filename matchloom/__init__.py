"""Spark-native variable matching: find which documented variables mean the same thing."""
