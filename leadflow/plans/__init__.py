"""Registered queries (one per operator of the inventory) and their oracles."""

from .catalog import REGISTRY  # noqa: F401
from . import fact_queries, agent_queries, governance_queries, log_queries, store_queries, stream_queries, temporal_queries  # noqa: F401  (registers)


def queries():
    return {k: e.build for k, e in REGISTRY.items()}


def oracle_sql():
    return {k: e.oracle for k, e in REGISTRY.items() if e.oracle}
