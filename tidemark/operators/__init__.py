"""Operators on event logs, from steps to statistics."""
