"""Lodestone: a Spark-native engine for catalog retrieval, fusion and curation."""

__version__ = "0.1.0"
