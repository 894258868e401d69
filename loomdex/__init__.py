"""A Spark-native code-index analytics engine."""

__version__ = "0.1.0"
