"""All queries, by importing the modules that register them."""

from meterlake.plans import card_queries, log_queries, trail_queries, usage_queries, view_queries  # noqa: F401
from meterlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
