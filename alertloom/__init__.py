"""alertloom: a PySpark-native analytics engine for regulatory alert data."""

__version__ = "0.1.0"
