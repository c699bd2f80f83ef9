"""Exact quantiles with bounded memory per task.

Spark's exact ``percentile`` keeps every distinct value of a column in its
aggregation buffer and merges all partitions' buffers in a single task:
fine for thousands of distinct values, not for a column of a 100 TB table.
``exact_quantiles`` takes three scans, whatever the data:

1. one aggregation with a mergeable rank sketch (KLL) per column. The sketch
   brackets every wanted rank: its rank error stays below ``RANK_ERROR``
   (four times the bound that holds for 99 % of sketches of size ``SKETCH_K``,
   and a rank more), so the quantile at q lies between its estimates for
   q - RANK_ERROR and q + RANK_ERROR;
2. one aggregation counts the rows below and inside every bracket. Should a
   rank lie outside its bracket all the same, the bracket is opened and the
   counts are taken again, so a sketch never makes a result wrong;
3. the rows inside the brackets (0.7 % of a column per quantile) are counted
   per value. Up to ``FETCH`` rows their counts are read off on the driver.
   Beyond it further estimates cut a bracket into ``CELLS`` cells, so that
   running counts are windows over one cell, and only the wanted values leave
   the cluster.

The results equal numpy's quantiles (linear interpolation).

``grouped_exact_quantiles`` works per group: distinct values are
counted per group, sorted by range and numbered by running totals, and every
group reads its ranks off the sorted table. One algorithm serves groups of
any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.common import col
from vellum.operators.ordered import running_total

SKETCH_K = 4096
RANK_ERROR = 0.0035
CELLS = 64
FETCH = 1 << 18  # rows inside all brackets that are read off on the driver


def _values(df: DataFrame, columns: list[str]):
    out = []
    for c in columns:
        dt = df.schema[c].dataType
        x = col(c).cast("double")
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            x = F.when(~F.isnan(x), x)
        out.append(x)
    return out


def _lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation (the form used by ``np.percentile``)."""
    if a == b:  # also two infinities, whose difference is no number
        return a
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


@dataclass
class _Bracket:
    """Where the ranks ``first`` and ``last`` of a column lie."""
    column: int
    first: int
    last: int
    share: float            # of the way from the first to the last
    lo: float | None        # None: open
    hi: float | None
    edges: list[float]      # inner cuts
    below: int = 0
    inside: int = 0
    found: tuple[float, float] | None = None

    def holds(self, x: Column) -> Column:
        """Whether a value lies inside."""
        out = x.isNotNull()
        out = out if self.lo is None else out & (x >= self.lo)
        return out if self.hi is None else out & (x <= self.hi)


def _brackets(df: DataFrame, xs: list[Column], qs: list[float]) -> list[list[_Bracket] | None]:
    """Per column (None: it is empty) a bracket for every q: one scan."""
    shares = [[min(max(q + RANK_ERROR * (2 * k / CELLS - 1), 0.0), 1.0) for k in range(CELLS + 1)] for q in qs]
    flat = F.array(*[F.lit(s) for own in shares for s in own])
    row = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                 *[F.kll_sketch_agg_double(x, SKETCH_K).alias(f"s{i}") for i, x in enumerate(xs)])
    row = row.select(*[F.col(f"n{i}") for i in range(len(xs))], *[
        F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", flat)).alias(f"e{i}") for i in range(len(xs))]).first()
    out: list[list[_Bracket] | None] = []
    for i in range(len(xs)):
        n = row[f"n{i}"]
        if not n:
            out.append(None)
            continue
        own = []
        for k, q in enumerate(qs):
            edges = list(row[f"e{i}"][k * (CELLS + 1):(k + 1) * (CELLS + 1)])
            at, large = (n - 1) * q, n > SKETCH_K  # a smaller column is its own bracket
            own.append(_Bracket(i, math.floor(at), math.ceil(at), at - math.floor(at),
                                edges[0] if large and q > RANK_ERROR else None,
                                edges[-1] if large and q < 1 - RANK_ERROR else None, edges[1:-1]))
        out.append(own)
    return out


def _count(df: DataFrame, xs: list[Column], brackets: list[_Bracket]) -> None:
    """Rows before, at and inside the ends of every bracket: one scan (another
    one only if a sketch was further off than its bound). Ranks that fall on
    an end, as in a column of few values, are found by that."""
    while brackets:
        aggs = []
        for k, b in enumerate(brackets):
            x = xs[b.column]
            zero, all_ = F.lit(0).cast("long"), F.count(x)
            aggs += [(zero if b.lo is None else F.count_if(x < b.lo)).alias(f"a{k}"),
                     (all_ if b.hi is None else F.count_if(x <= b.hi)).alias(f"d{k}")]
            if b.lo is None or b.lo != b.hi:  # else the bracket is one value
                aggs += [(zero if b.lo is None else F.count_if(x <= b.lo)).alias(f"b{k}"),
                         (all_ if b.hi is None else F.count_if(x < b.hi)).alias(f"c{k}")]
        row = df.agg(*aggs).first().asDict()
        missed = []
        for k, b in enumerate(brackets):
            before, end = row[f"a{k}"], row[f"d{k}"]
            to_lo, to_hi = row.get(f"b{k}", end), row.get(f"c{k}", before)
            b.below, b.inside = before, end - before
            if b.first < before or b.last >= end:
                b.lo = b.hi = None
                missed.append(b)
                continue
            at = [b.lo if r < to_lo else b.hi if r >= to_hi else None for r in (b.first, b.last)]
            if None not in at:
                b.found = (at[0], at[1])
        brackets = missed


def _read(df: DataFrame, xs: list[Column], brackets: list[_Bracket]) -> list[tuple[float, float]]:
    """Values at the two ranks of every bracket: one scan."""
    items = [F.when(b.holds(xs[b.column]), F.struct(F.lit(k).alias("k"), xs[b.column].alias("v"))) for k, b in enumerate(brackets)]
    near = reduce(lambda a, b: a | b, [b.holds(xs[b.column]) for b in brackets])  # few rows are left to explode
    rows = df.filter(near).select(F.explode(F.array(*items)).alias("s")).filter("s IS NOT NULL").select("s.k", "s.v")
    # -0.0 and 0.0 are one value
    counted = rows.groupBy("k", (F.col("v") + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    if sum(b.inside for b in brackets) <= FETCH:
        table = counted.toPandas().sort_values(["k", "v"])
        out = []
        for k, b in enumerate(brackets):
            own = table[table["k"] == k]
            v, end = own["v"].to_numpy(), own["c"].to_numpy().cumsum()
            low, high = end.searchsorted([b.first - b.below, b.last - b.below], side="right")
            out.append((float(v[low]), float(v[high])))
        return out
    edges = F.get(F.array(*[F.array(*[F.lit(float(e)) for e in b.edges]) for b in brackets]), F.col("k"))
    counted = counted.withColumn("cell", F.size(F.filter(edges, lambda e: e < F.col("v"))))
    cells = counted.groupBy(F.col("k").alias("_k"), F.col("cell").alias("_cell")).agg(F.sum("c").alias("_c"))
    before = Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    within = Window.partitionBy("k", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # CELLS rows per wanted quantile
    placed = counted.withColumn("_end", F.sum("c").over(within)).join(
        F.broadcast(cells), (F.col("k") == F.col("_k")) & (F.col("cell") == F.col("_cell")))
    first, last = (F.get(F.array(*[F.lit(r - b.below) for b, r in ranks]), F.col("k"))
                   for ranks in ([(b, b.first) for b in brackets], [(b, b.last) for b in brackets]))
    end = F.col("_before") + F.col("_end")
    start = end - F.col("c")
    got = placed.groupBy("k").agg(F.max(F.when((first >= start) & (first < end), F.col("v"))).alias("a"),
                                  F.max(F.when((last >= start) & (last < end), F.col("v"))).alias("b")).collect()
    found = {r["k"]: (r["a"], r["b"]) for r in got}
    return [found[k] for k in range(len(brackets))]


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float], median_mean: bool = True) -> dict[str, list[float | None]]:
    """``{column: [quantile for q in qs]}`` (nulls and NaN ignored; None for an
    empty column). ``median_mean``: q = 0.5 is the mean of the two middle
    values, as ``np.median`` / pandas ``median``; other q interpolate linearly."""
    if not columns or not qs:
        return {c: [] for c in columns}
    xs = _values(df, columns)
    own = _brackets(df, xs, qs)
    flat = [b for x in own if x for b in x]
    _count(df, xs, flat)
    open_ = [b for b in flat if b.found is None]
    for b, found in zip(open_, _read(df, xs, open_) if open_ else [], strict=True):
        b.found = found
    out: dict[str, list[float | None]] = {}
    for c, brackets in zip(columns, own, strict=True):
        out[c] = []
        for q, b in zip(qs, brackets or [None] * len(qs), strict=True):
            if b is None:
                out[c].append(None)
                continue
            low, high = b.found
            middle = q == 0.5 and median_mean and low != high
            out[c].append((low + high) / 2 if middle else _lerp(low, high, b.share))
    return out


def grouped_exact_quantiles(df: DataFrame, group: str, column: str, qs: list[float],
                            median_mean: bool = True) -> DataFrame:
    """``group, q0, q1, ...``: exact quantiles of every group (null keys are a
    group; null for a group without values), numpy's linear interpolation;
    ``median_mean``: q = 0.5 is the mean of the two middle values.

    Values are counted per (group, value), range-partitioned by both - so a
    hot group spreads over many tasks and a hot value is one row - and
    numbered by running totals."""
    x = _values(df, [column])[0]
    rows = df.select(col(group).alias("_g"), x.alias("_v"))
    counted = rows.groupBy("_g", "_v").agg(F.count("_v").alias("_n"))  # 0 for missing values: the group stays
    ends = running_total(counted, ["_g", "_v"], "_n", "_end")
    per = ends.groupBy("_g").agg(F.min(F.col("_end") - F.col("_n")).alias("_start"), F.sum("_n").alias("_size"))
    per = per.select(F.col("_g").alias("_k"), "_start", "_size")
    joined = ends.join(per, F.col("_g").eqNullSafe(F.col("_k")))
    first, last = F.col("_end") - F.col("_n") - F.col("_start"), F.col("_end") - F.col("_start")
    aggs, outs = [], []
    for i, q in enumerate(qs):
        pos = (F.col("_size") - 1) * F.lit(float(q))
        for name, rank in ((f"_a{i}", F.floor(pos)), (f"_b{i}", F.ceil(pos))):
            aggs.append(F.max(F.when((rank >= first) & (rank < last), F.col("_v"))).alias(name))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_t{i}"))
        a, b, t = F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_t{i}")
        lerp = F.when(t >= 0.5, b - (b - a) * (1 - t)).otherwise(a + (b - a) * t)
        value = (a + b) / 2 if q == 0.5 and median_mean else lerp
        outs.append(F.when(a == b, a).otherwise(value).alias(f"q{i}"))
    return joined.groupBy("_g").agg(*aggs).select(F.col("_g").alias(group), *outs)
