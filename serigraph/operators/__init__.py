"""Operators on panels, words and bags."""
