"""Spark-native analytics for detector evaluation across image resolutions."""
