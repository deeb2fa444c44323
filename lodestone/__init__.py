"""lodestone: a PySpark-native document analytics and retrieval engine."""

__version__ = "0.1.0"
