"""Spark-native preparation of AI training data: scans, dedup, denoising, evaluation, parsing and synthesis."""

__version__ = "0.1.0"
