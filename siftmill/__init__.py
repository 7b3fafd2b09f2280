"""siftmill: a Spark-native engine for understanding large collections of files and documents."""

__version__ = "0.1.0"
