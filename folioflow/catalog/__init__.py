"""One query per operator over the given tables."""

from folioflow.catalog import (  # noqa: F401  (each module registers its queries)
    applying, changes, context, events, instructions, locating, review, selection, text,
)
from folioflow.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
