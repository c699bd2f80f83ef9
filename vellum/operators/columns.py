"""Column subsets by kind (numeric / categorical / datetime / object / all)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellum.functions.numeric import kind_of


def column_options(df: DataFrame, kind: str = "all") -> list[str]:
    """Names of the columns of one kind; ``object`` means text columns,
    unknown kinds give all columns (no job: read from the schema)."""
    kinds = {"numeric": ("numeric",), "categorical": ("categorical", "boolean"),
             "datetime": ("datetime",), "object": ("categorical",)}
    wanted = kinds.get(kind)
    if wanted is None:
        return list(df.columns)
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in wanted]
