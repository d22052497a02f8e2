"""Arrivals of fact streams."""
