"""Registered queries: a Spark plan over the views and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocarium.plans.views import Views, ctes, shared_views

Plan = Callable[[Views], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan; ``oracle`` names views as ``{view}``."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return register


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return PLANS[name](shared_views(spark, folder))

    run.__name__ = name
    return run


def oracle_text(name: str) -> str:
    return ctes(ORACLES[name])
