"""Chain-regime analytics on Spark."""
