"""All queries of the library itself, with their SQL."""

from objekta.plans import gathered, objects, values  # noqa: F401
from objekta.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
