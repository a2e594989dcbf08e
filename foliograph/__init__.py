"""Page-level document analytics and retrieval on Spark."""
