"""Panels of series from tables."""
