"""Registry of the queries: name -> (Spark plan over a pipeline, cross-check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesslens.plans.oracle_base import query
from accesslens.plans.pipeline import Pipeline

Plan = Callable[[Pipeline], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def add(name: str, plan: Plan, sql: str | None = None, *needs: str) -> None:
    if name in PLANS:
        raise ValueError(f"query {name} registered twice")
    PLANS[name] = plan
    if sql is not None:
        SQL[name] = query(sql, *needs)


def us(column: str = "timestamp", name: str = "us") -> Column:
    """A timestamp as microseconds, the same number in every engine and time zone."""
    return F.unix_micros(column).alias(name)


def tagged(**tables: DataFrame) -> DataFrame:
    """Union of tables with equal columns, told apart by ``source``."""
    merged = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("source"), "*")
        merged = part if merged is None else merged.unionByName(part)
    return merged
