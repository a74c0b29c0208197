"""PySpark-native analytics over airline on-time records."""
