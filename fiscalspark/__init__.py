"""A PySpark-native analytics engine for public-budget data."""
