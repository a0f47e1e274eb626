"""All queries of the library, by name."""

from . import dose, items, ledgers, paired, scoring, storing, streams
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dose", "items", "ledgers", "paired", "scoring", "storing", "streams"]
