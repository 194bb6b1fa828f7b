"""Operators for preparing training text, each with a registered query."""
