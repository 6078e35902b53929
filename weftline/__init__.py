"""weftline: a Spark-native engine for the data side of asynchronous batch inference."""

__version__ = "0.1.0"
