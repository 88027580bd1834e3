"""All registered queries of the engine, and their SQL oracles."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
