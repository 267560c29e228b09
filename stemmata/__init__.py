"""A PySpark-native analytics engine for versioned text."""
