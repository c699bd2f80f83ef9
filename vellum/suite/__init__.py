"""Registered queries: each pairs a Spark job with the ANSI SQL (DuckDB
dialect) that computes the same table, for the correctness gate.

A query is registered with ``@query(name, sql=..., views=..., rounds=...)``.
``views`` lists the derived views (``vellum.sources.tables.VIEWS``) the
oracle needs inlined; ``rounds`` maps floating columns to the number of
decimals both sides are rounded to, because sums run in a different
order on the two engines; ``"f"`` casts to FLOAT instead (binary
rounding, for model outputs whose exact values often sit on a decimal
tie that the two engines break differently).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import tables


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    views: tuple = ()
    rounds: dict = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir)
        df = self.build(spark, sf_dir)
        if self.rounds:
            df = df.select(*[_round(F.col(f"`{c}`"), self.rounds[c]).alias(c) if c in self.rounds
                             else F.col(f"`{c}`") for c in df.columns])
        return df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = tables.with_views(self.sql, *self.views)
        if not self.rounds:
            return body
        repl = ", ".join((f'CAST("{c}" AS FLOAT) AS "{c}"' if d == "f" else f'round("{c}", {d}) AS "{c}"')
                         for c, d in self.rounds.items())
        return f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) AS _q"


def _round(c, digits):
    return c.cast("float") if digits == "f" else F.round(c, digits)


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views=(), rounds=None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(views), dict(rounds or {}))
        return fn
    return deco


MODULES = ("cleaning", "transforms", "features", "quality", "profiling", "relations", "joins",
           "sqlconf", "kpis", "anomalies", "timeseries", "charts", "segments",
           "documents", "sources", "streams", "jobs", "udfs", "limits")


def load_all() -> dict[str, Query]:
    for m in MODULES:
        try:
            importlib.import_module(f"vellum.suite.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"vellum.suite.{m}":
                raise
    return REGISTRY
