"""Document-collection operations over JSON documents in Spark.

``find`` translates a filter document (``$eq $gt $gte $lt $lte $ne $in
$nin $exists $regex $and $or $nor $not``; dotted paths reach nested
fields) into one Column predicate, pushed down like any filter.
``aggregate`` maps pipeline stages onto DataFrame operations: ``$match``
filter, ``$project`` select, ``$addFields`` withColumn, ``$group``
groupBy/agg (``$sum $avg $min $max $count $first $last``), ``$sort``,
``$skip``, ``$limit``, ``$unwind`` explode and ``$lookup`` left join.
Array-building accumulators (``$push``, ``$addToSet``) are not offered:
they would collect a whole group into one row; ``$lookup`` therefore
emits one row per match (its matches unwound) instead of an array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _value(v):
    """``"$field"`` references a field, anything else is a literal."""
    if isinstance(v, str) and v.startswith("$"):
        return _field(v[1:])
    if isinstance(v, dict):
        return expression(v)
    return F.lit(v)


def expression(spec) -> Column:
    """A small expression language: $add $subtract $multiply $divide $concat $toLower $toUpper."""
    if not isinstance(spec, dict):
        return _value(spec)
    (op, args), = spec.items()
    vals = [_value(a) for a in (args if isinstance(args, list) else [args])]
    if op == "$add":
        return reduce(lambda a, b: a + b, vals)
    if op == "$subtract":
        return vals[0] - vals[1]
    if op == "$multiply":
        return reduce(lambda a, b: a * b, vals)
    if op == "$divide":
        return F.try_divide(vals[0], vals[1])
    if op == "$concat":
        return F.concat(*vals)
    if op == "$toLower":
        return F.lower(vals[0])
    if op == "$toUpper":
        return F.upper(vals[0])
    raise ValueError(f"Unsupported expression operator: {op}")


def _condition(field: str, cond) -> Column:
    c = _field(field)
    if not isinstance(cond, dict) or not any(str(k).startswith("$") for k in cond):
        return c == F.lit(cond) if cond is not None else c.isNull()
    parts = []
    for op, v in cond.items():
        if op == "$eq":
            parts.append(c.isNull() if v is None else c == F.lit(v))
        elif op == "$ne":
            parts.append(c.isNotNull() if v is None else (c.isNull() | (c != F.lit(v))))
        elif op == "$gt":
            parts.append(c > F.lit(v))
        elif op == "$gte":
            parts.append(c >= F.lit(v))
        elif op == "$lt":
            parts.append(c < F.lit(v))
        elif op == "$lte":
            parts.append(c <= F.lit(v))
        elif op == "$in":
            parts.append(c.isin(list(v)))
        elif op == "$nin":
            parts.append(c.isNull() | ~c.isin(list(v)))
        elif op == "$exists":
            parts.append(c.isNotNull() if v else c.isNull())
        elif op == "$regex":
            parts.append(c.rlike(v))
        elif op == "$not":
            parts.append(~F.coalesce(_condition(field, v), F.lit(False)))  # null does not match -> $not matches
        else:
            raise ValueError(f"Unsupported query operator: {op}")
    return reduce(lambda a, b: a & b, parts)


def filter_column(spec: dict | None) -> Column:
    """Column predicate for a filter document. A comparison with a null is
    null, which a filter drops exactly like false, so plain comparisons stay
    bare and are pushed down to the scan; only under a negation ($nor, $not)
    is null first turned into "no match"."""
    if not spec:
        return F.lit(True)
    parts = []
    for k, v in spec.items():
        if k == "$and":
            parts.append(reduce(lambda a, b: a & b, [filter_column(x) for x in v]))
        elif k == "$or":
            parts.append(reduce(lambda a, b: a | b, [filter_column(x) for x in v]))
        elif k == "$nor":
            parts.append(~reduce(lambda a, b: a | b, [F.coalesce(filter_column(x), F.lit(False)) for x in v]))
        else:
            parts.append(_condition(k, v))
    return reduce(lambda a, b: a & b, parts)


def find(df: DataFrame, query: dict | None = None, projection: dict | None = None,
         limit: int | None = None) -> DataFrame:
    """Every matching document, without ``_id``; ``limit`` keeps that many."""
    out = df.filter(filter_column(query))
    if projection:
        out = _project(out, projection)
    if "_id" in out.columns:
        out = out.drop("_id")
    return out if limit is None else out.limit(limit)


def _project(df: DataFrame, spec: dict) -> DataFrame:
    include = {k: v for k, v in spec.items() if v not in (0, False)}
    exclude = [k for k, v in spec.items() if v in (0, False)]
    if include:
        cols = [(_field(k) if v in (1, True) else _value(v)).alias(k) for k, v in include.items()]
        if "_id" in df.columns and "_id" not in exclude and "_id" not in include:
            cols.insert(0, F.col("_id"))
        return df.select(*cols)
    return df.drop(*exclude)


ACCUMULATORS = {
    "$sum": lambda v: F.sum(v), "$avg": lambda v: F.avg(v), "$min": lambda v: F.min(v),
    "$max": lambda v: F.max(v), "$first": lambda v: F.first(v), "$last": lambda v: F.last(v),
}


def _ordered_pick(op: str, value: Column, order: list[tuple[str, int]]) -> Column:
    """``$first`` / ``$last`` after a ``$sort``: the value at the group's first
    or last sort key (nulls lowest, as in the document store). The value sits
    in a struct, so a null value can be picked too."""
    if len({way >= 0 for _, way in order}) > 1:
        raise ValueError("$first / $last need one direction for all $sort keys")
    keys = F.struct(*[x for path, _ in order for x in (_field(path).isNotNull(), _field(path))])
    pick = F.min_by if (op == "$first") == (order[0][1] >= 0) else F.max_by
    return pick(F.struct(value.alias("v")), keys)["v"]


def _group(df: DataFrame, spec: dict, order: list[tuple[str, int]] | None = None) -> DataFrame:
    key = spec.get("_id")
    if key is None:
        keys = []
    elif isinstance(key, dict):
        keys = [_value(v).alias(k) for k, v in key.items()]
    else:
        keys = [_value(key).alias("_id")]
    aggs = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        (op, arg), = acc.items()
        if op == "$count":
            aggs.append(F.count(F.lit(1)).alias(name))
        elif op in ("$first", "$last") and order:
            aggs.append(_ordered_pick(op, _value(arg), order).alias(name))
        elif op in ACCUMULATORS:
            aggs.append(ACCUMULATORS[op](_value(arg)).alias(name))
        else:
            raise ValueError(f"Unsupported accumulator: {op}")
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    if isinstance(key, dict):
        g = g.select(F.struct(*[F.col(k) for k in key]).alias("_id"), *[F.col(a) for a in spec if a != "_id"])
    elif key is None:
        g = g.select(F.lit(None).alias("_id"), "*")
    return g


def aggregate(df: DataFrame, stages: list[dict], collections: dict[str, DataFrame] | None = None,
              drop_id: bool = True) -> DataFrame:
    """Run the stages; as the reference, ``_id`` is dropped from the result
    (which also drops a ``$group`` key) unless ``drop_id=False``."""
    out = df
    order: list[tuple[str, int]] = []  # of the last $sort, as long as rows keep it
    looked_up: set[str] = set()  # already one row per match
    for stage in stages:
        (op, arg), = stage.items()
        if op == "$match":
            out = out.filter(filter_column(arg))
        elif op == "$project":
            out = _project(out, arg)
        elif op == "$addFields":
            for k, v in arg.items():
                out = out.withColumn(k, _value(v))
        elif op == "$group":
            out, order = _group(out, arg, order), []
        elif op == "$sort":
            order = list(arg.items())
            out = out.orderBy(*[(_field(k).asc() if v >= 0 else _field(k).desc()) for k, v in arg.items()])
        elif op == "$limit":
            out = out.limit(int(arg))
        elif op == "$skip":
            out = out.offset(int(arg))
        elif op == "$unwind":
            path = arg if isinstance(arg, str) else arg["path"]
            keep = isinstance(arg, dict) and arg.get("preserveNullAndEmptyArrays")
            name = path.lstrip("$")
            if name in looked_up:  # $lookup gave one row per match: only rows without one can go
                out = out if keep else out.filter(_field(name).isNotNull())
                continue
            fn = F.explode_outer if keep else F.explode
            root, _, rest = name.partition(".")
            if not rest:
                out = out.withColumn(name, fn(_field(name)))
            else:  # inside a struct: explode beside it, then put the element in its place
                out = out.select("*", fn(_field(name)).alias("__element"))
                out = out.withColumn(root, F.col(f"`{root}`").withField(rest, F.col("__element"))).drop("__element")
        elif op == "$lookup":
            other = (collections or {})[arg["from"]]
            right = other.select(F.col(f"`{arg['foreignField']}`").alias("_fk"),
                                 F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias(arg["as"]))
            out = out.join(right, _field(arg["localField"]) == F.col("_fk"), "left").drop("_fk")
            looked_up.add(arg["as"])
        elif op == "$count":
            out = out.agg(F.count(F.lit(1)).alias(arg))
        else:
            raise ValueError(f"Unsupported pipeline stage: {op}")
    return out.drop("_id") if drop_id and "_id" in out.columns else out


def as_documents(events: DataFrame) -> DataFrame:
    """The events table shaped as nested documents (``_id``, nested ``user``,
    parsed ``props``): the collection the document operators are tested on."""
    return events.select(F.col("event_id").alias("_id"), F.struct(F.col("user_id").alias("id")).alias("user"),
                         F.col("event_type").alias("type"), "value", "ts",
                         F.from_json("props", "k INT").alias("props"))
