"""All registered queries."""
from tapeworks.plans import book, features, feeds, market_data, stats, strategies, streams  # noqa: F401
from tapeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
