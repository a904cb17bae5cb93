"""Registry of catalog queries: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Builder
    sql: str | None
    family: str


REGISTRY: dict[str, QuerySpec] = {}


def register(name: str, sql: str | None = None, family: str = ""):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, sql, family)
        return fn
    return deco


def load_all() -> dict[str, QuerySpec]:
    # import for registration side effects
    from gatewatch.plans import (q_audit, q_privacy, q_detect, q_features,  # noqa: F401
                                 q_evaluate, q_accounts, q_results, q_models,
                                 q_streaming)
    return REGISTRY
