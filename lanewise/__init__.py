"""Competition-results analytics on Spark."""
