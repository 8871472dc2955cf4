"""Reading, writing and staging tables."""
