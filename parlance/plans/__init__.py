"""Composed queries and their SQL."""
