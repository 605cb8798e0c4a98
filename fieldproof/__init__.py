"""Spark-native evaluation of evidence-cited field extraction, and operators for training corpora."""

__version__ = "0.1.0"
