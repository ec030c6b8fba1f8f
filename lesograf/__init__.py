"""Spark-native analytics for dependency treebanks and plain text corpora."""
