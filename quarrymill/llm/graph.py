"""Connected components over links in a DataFrame: those of the library."""

from quarrymill.operators.graphs import components as connected

__all__ = ["connected"]
