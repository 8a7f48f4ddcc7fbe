"""Spark-native engine for fibre network planning over site, hub, building and road tables."""
