"""A Spark-native engine for annotated game books and text corpora."""

__version__ = "0.1.0"
