"""Registered queries, each beside the SQL that checks it."""

from swingtrace.plans import basics, causes, checks, detection, reports, signals, streams  # noqa: F401
from swingtrace.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
