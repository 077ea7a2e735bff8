"""glyphflow: a PySpark-native engine for text tracks and text corpora."""

__version__ = "0.1.0"
