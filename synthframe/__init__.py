"""synthframe: a PySpark-native engine for synthetic test data at table scale."""

__version__ = "0.1.0"
