"""Spark-native analytics over knowledge corpora: compile, check, index, search, evaluate."""
