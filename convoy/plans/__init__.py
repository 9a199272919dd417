"""Registered queries: fixture views, Spark plans and their SQL twins."""

from convoy.plans import figures, fleet, ingest, mappings, rule_checks, streams, watch  # noqa: F401
from convoy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
