"""Registered queries: name → (Spark function, comparison SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.scale import tune

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

MODULES = ("graph", "votes", "corpora", "records")


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a function under its own name."""

    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return plain_types(fn(tune(spark), sf))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def plain_types(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, integers as BIGINT, floats as DOUBLE: the same in any engine."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "array<string>":
            c = F.array_join(c, ",")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind == "float":
            c = c.cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tagweave.plans.{name}")
