"""plans of the hourly jobs."""
