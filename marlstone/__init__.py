"""marlstone: a PySpark-native listing evidence engine."""

__version__ = "0.1.0"
