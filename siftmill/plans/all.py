"""All registered queries."""

from . import advice, dedup, functions, history, library, reads, relations, scores  # noqa: F401
from . import written  # noqa: F401  isort: skip  (after all others, whose queries it takes)
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
