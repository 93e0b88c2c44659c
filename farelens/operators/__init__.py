"""Reusable DataFrame-to-DataFrame operations."""
