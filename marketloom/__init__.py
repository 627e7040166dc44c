"""Market analytics on Spark."""
