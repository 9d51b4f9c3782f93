"""millrace: a PySpark-native engine for recorded coding sessions and benchmark outcomes."""

__version__ = "0.1.0"
