"""Spark-native analytics over travel geometry, timetables and text corpora."""
