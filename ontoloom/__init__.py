"""Spark-native ontology analytics: extraction, alignment, reasoning and record-quality operators as DataFrame plans."""

__version__ = "0.1.0"
