"""passant: Spark-native passage-utility analytics."""

__version__ = "0.1.0"
