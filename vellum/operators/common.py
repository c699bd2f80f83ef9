"""Shared checks for operators: all raised on the driver from df.schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class StepError(ValueError):
    """A step's parameters do not fit the frame (raised before any job)."""


def col(name: str) -> Column:
    """Reference a column whose name may contain spaces, dots or ``^``."""
    return F.col(f"`{name.replace('`', '``')}`")


def require_columns(df: DataFrame, *names: str | None, what: str = "Column") -> None:
    for n in names:
        if not n or n not in df.columns:
            raise KeyError(f"{what} '{n}' is not among the table's columns.")


def dtype(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise KeyError(f"'{name}' is not among the table's columns.")


def present(df: DataFrame, name: str) -> Column:
    """A column with NaN as null, the one meaning of "missing" in this library."""
    c = col(name)
    return F.when(~F.isnan(c), c) if isinstance(dtype(df, name), (T.FloatType, T.DoubleType)) else c


def as_list(v) -> list:
    if v is None:
        return []
    if isinstance(v, (list, tuple)):
        return list(v)
    return [v]


def replace_column(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Replace ``name`` in place, keeping the column order."""
    return df.select(*[expr.alias(c) if c == name else col(c) for c in df.columns])


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key: list | None = None) -> DataFrame:
    """``n`` rows chosen by a seeded hash (md5 of the seed and the key's texts):
    repeatable on any engine, and computed as a top-k (each partition keeps
    its n smallest hashes), with no full sort and no driver round trip."""
    cols = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (key or df.columns)]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))
    return df.withColumn("__h", digest).orderBy("__h", *[col(c) for c in (key or [])]).limit(n).drop("__h")
