"""Spark-native analytics for traced trees, point clouds, volumes and registrations."""
