"""corvane: Spark-native corpus analytics, lexical retrieval and evaluation."""

__version__ = "0.1.0"
