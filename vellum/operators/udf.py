"""User functions as Spark stages (no code text is executed).

* ``custom_step(df, fn)``: a Python callable ``DataFrame -> DataFrame``;
* ``per_batch(df, fn, schema)``: ``mapInPandas``, Arrow batches of rows;
* ``per_group(df, keys, fn, schema)``: ``applyInPandas``; every group goes
  to one worker, so group the pre-aggregated table (bounded groups), not
  raw rows of a possibly hot key;
* ``grouped_aggregate``: a pandas aggregate UDF over bounded groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def custom_step(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = df.transform(fn)
    if not isinstance(out, DataFrame):
        raise ValueError("A custom step must return a DataFrame.")
    return out


def per_batch(df: DataFrame, fn, schema) -> DataFrame:
    return df.mapInPandas(fn, schema)


def per_group(df: DataFrame, keys: list, fn, schema) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fn, schema)


def grouped_aggregate(df: DataFrame, keys: list, udf_col, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(udf_col.alias(name))
