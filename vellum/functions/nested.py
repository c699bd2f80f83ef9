"""Nested lookup with a default (struct fields, map keys, array positions, JSON text)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_get(df: DataFrame, keys: list, default=None) -> Column:
    """Follow ``keys`` from a top-level column: a struct field by name, a map
    value by key, an array element by 0-based position, or, inside JSON
    text, the remaining path. A missing field or key, an out-of-range
    position or a null on the way gives ``default`` (no analysis error:
    the path is checked against the schema on the driver)."""
    if not keys:
        raise ValueError("keys must name at least the top-level column")
    first, rest = keys[0], list(keys[1:])
    if first not in df.columns:
        return F.lit(default)
    c: Column = F.col(f"`{first}`")
    dt: T.DataType = df.schema[first].dataType
    for i, k in enumerate(rest):
        if isinstance(dt, T.StructType):
            if k not in dt.fieldNames():
                return F.lit(default)
            c, dt = c.getField(k), dt[k].dataType
        elif isinstance(dt, T.MapType):
            c, dt = F.try_element_at(c, F.lit(k)), dt.valueType
        elif isinstance(dt, T.ArrayType):
            if not isinstance(k, int):
                return F.lit(default)
            c, dt = F.try_element_at(c, F.lit(k + 1 if k >= 0 else k)), dt.elementType
        elif isinstance(dt, T.StringType):
            path = "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in rest[i:])
            c = F.get_json_object(c, path)
            if default is not None and not isinstance(default, str):
                c = c.try_cast(T.DoubleType() if isinstance(default, float) else T.LongType())
            return F.coalesce(c, F.lit(default)) if default is not None else c
        else:
            return F.lit(default)
    if default is None:
        return c
    lit = F.lit(json.dumps(default) if isinstance(default, (list, dict)) else default)
    return F.coalesce(c, lit.cast(dt)) if not isinstance(dt, (T.StructType, T.ArrayType, T.MapType)) else c
