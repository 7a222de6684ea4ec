"""Operators for training text; nothing else of the library imports this sub-package."""
