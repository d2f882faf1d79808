"""tessera: a PySpark-native engine for long-lived text memory."""

__version__ = "0.1.0"
