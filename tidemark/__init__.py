"""A PySpark-native engine that turns collections of items into a clean, time-partitioned archive."""
