"""Rental-market analytics and corpus preparation on Spark."""
