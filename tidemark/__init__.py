"""Daily-series analytics on Spark."""
