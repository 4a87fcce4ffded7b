"""Spark-native analytics over many keyed series, tables, texts and graphs."""
