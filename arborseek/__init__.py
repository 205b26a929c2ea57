"""Spark-native document retrieval engine: chunking, postings, boolean ranked search, context and more-like-this."""

__version__ = "0.1.0"
