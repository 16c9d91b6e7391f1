"""Continuous forms of window features."""
