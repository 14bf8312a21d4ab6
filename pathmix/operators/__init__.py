"""Operators over paths, windows, counts, distributions and graphs."""
