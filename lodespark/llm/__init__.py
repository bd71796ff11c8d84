"""Operators on training text. Nothing else of the library imports this subpackage."""
