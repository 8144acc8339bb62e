"""Whole searches as one lazy plan."""
