"""Sources of the rental-market engine."""
