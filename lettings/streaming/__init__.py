"""Streaming of the rental-market engine."""
