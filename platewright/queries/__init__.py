"""All queries and their SQL: the registry's own and those of the modules here."""

from platewright.queries import boxes, codes, colours, contours, documents, files, programs, rasters, results  # noqa: F401
from platewright.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
