"""Spark-native reliability analytics for weather-station readings."""
