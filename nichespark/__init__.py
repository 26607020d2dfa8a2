"""nichespark: spatial-cell analytics as PySpark DataFrame plans over `cells` and `edges` tables."""

__version__ = "0.1.0"
