"""operators of the hourly jobs."""
