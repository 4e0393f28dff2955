"""Feature-selection jobs and training-data operators for Spark."""
