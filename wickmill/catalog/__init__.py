"""Registered queries: every operator over the driver's tables, each with its SQL counterpart."""

from wickmill.catalog.registry import all_oracles, all_queries

__all__ = ["all_oracles", "all_queries"]
