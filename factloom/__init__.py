"""Evidence reconciliation analytics on Spark."""
