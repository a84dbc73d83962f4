"""Hourly, multi-region time-series analytics as Spark DataFrame plans."""
