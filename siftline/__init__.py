"""siftline: a PySpark-native engine for cleaning and restructuring messy tables."""

__version__ = "0.1.0"
