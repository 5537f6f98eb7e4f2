"""PySpark-native engine for evidence-backed knowledge graphs."""

__version__ = "0.1.0"
