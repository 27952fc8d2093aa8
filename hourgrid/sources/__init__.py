"""sources of the hourly jobs."""
