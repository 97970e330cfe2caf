"""PySpark-native analytics over code-property graphs."""
