"""Commerce analytics as PySpark DataFrame plans."""

from tradeloom.tables import Tables

__all__ = ["Tables"]
