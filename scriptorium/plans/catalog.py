"""All registered queries."""

from . import q_compare, q_counts, q_groups, q_impact, q_networks, q_sources, q_trends  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
