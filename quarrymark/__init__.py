"""quarrymark: a Spark-native engine for schema discovery and data profiling."""

__version__ = "0.1.0"
