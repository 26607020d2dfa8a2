"""Operators for preparing training text. Nothing else in nichespark imports this subpackage."""
