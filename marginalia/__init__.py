"""Spark-native analytics for multi-annotator text-labelling projects."""
