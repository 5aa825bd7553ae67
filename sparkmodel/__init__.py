"""sparkmodel: a Spark-native data-transformation and query engine."""

__version__ = "0.1.0"
