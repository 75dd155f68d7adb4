"""A PySpark-native analytics engine for team content, work tracking and training data."""
