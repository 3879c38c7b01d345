"""Plans of the rental-market engine."""
