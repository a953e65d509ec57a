"""Registered queries: a Spark plan over the given tables and, where plain SQL
can say the same, its twin for a second engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    twin: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, twin: str | None = None):
    def register(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, plan, twin)
        return plan

    return register


def load() -> dict[str, Query]:
    from weblode.catalog import attempts, corpus, graphs, jobs, pages, platforms, urls  # noqa: F401, I001
    from weblode.catalog import streams  # noqa: F401  (names twins of the others)

    return REGISTRY
