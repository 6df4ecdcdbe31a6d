"""Text-feature analytics on Spark: features, evidence, lexicons and statistics over document tables."""

__version__ = "0.1.0"
