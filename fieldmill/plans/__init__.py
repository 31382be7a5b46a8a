"""Queries over the driver's tables, with their SQL."""

from . import queries, records, runs
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries", "records", "runs"]
