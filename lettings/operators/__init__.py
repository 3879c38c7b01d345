"""Operators that need rounds or Python: components, greedy groups, sequence similarity."""
