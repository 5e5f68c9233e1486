"""Spark-native tables and operators for timed transcripts, clips, posts and training text."""
