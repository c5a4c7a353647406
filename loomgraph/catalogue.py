"""All registered queries of the core; importing the modules registers them."""

from . import cases, cases_views  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
