"""functions of the hourly jobs."""
