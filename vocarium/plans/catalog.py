"""All registered queries."""

from vocarium.plans import search_queries, stream_queries, table_queries, text_queries, upkeep_queries  # noqa: F401
from vocarium.plans.registry import ORACLES, PLANS, oracle_text, runnable

__all__ = ["ORACLES", "PLANS", "oracle_text", "runnable"]
