"""Text-to-graph analytics on Spark."""
