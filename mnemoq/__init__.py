"""Session-memory analytics and training-data operators on Spark."""
