"""Spark jobs over hourly market and weather series."""
