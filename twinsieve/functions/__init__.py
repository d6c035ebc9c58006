"""Near-duplicate analytics on Spark."""
