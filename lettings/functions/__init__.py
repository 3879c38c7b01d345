"""Functions of the rental-market engine."""
