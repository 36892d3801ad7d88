"""PySpark-native analytics over regulatory text and versioned compliance graphs."""
