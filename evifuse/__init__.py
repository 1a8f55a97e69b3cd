"""Spark-native evidence-fusion analytics: declarative DataFrame operators over sensor, evaluation and map tables."""

__version__ = "0.1.0"
