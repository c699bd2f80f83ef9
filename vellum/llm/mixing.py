"""Mixing sources to target weights.

Words are summed per source; the mix of ``ratio`` times all words is shared
by weight, a source's target stops at ``cap`` times its words and the excess
is shared again by weight among the others (water-filling, solved in closed
form on the per-source table). ``rate = target / words`` then gives every
document ``floor(rate)`` copies and one more when a hash of (seed, id) falls
below the fractional part, so reruns and any partitioning agree and no copy
count depends on other rows.

Defined cases: null or empty texts have size 0 and are taken zero times or
more without changing any total; null sources form one source, last in
order; repeated rows with one id share the decision; an empty table gives no
rows; a source without words has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import words_sql

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, ratio: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """``(_source, source_size, target)`` from ``(_source, size)`` rows.

    A source is capped when its cap is reached at the common level
    (words per weight) of the others: sorted by cap / weight, the capped
    ones are a prefix, found with running sums over one row per source.
    """
    per = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("_source").asc_nulls_last())  # one row per source
    pick = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(pick, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(float(ratio))
    per = (per.withColumn("_total", F.least(total, F.sum("_cap").over(everything)))
           .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(by_level), F.lit(0.0)))
           .withColumn("_w_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_level), F.lit(0.0)))
           .withColumn("_level", (F.col("_total") - F.col("_cap_before")) / F.col("_w_left"))
           .withColumn("_nth", F.row_number().over(Window.orderBy(F.col("_cap") / F.col("_w"),
                                                                  F.col("_source").asc_nulls_last())))
           # the first source below its cap: its level holds from there on
           .withColumn("_open", F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_nth")))
                       .over(everything))
           .withColumn("_final", F.max(F.when(F.col("_nth") == F.col("_open"), F.col("_level"))).over(everything)))
    target = F.when(F.col("_open").isNull() | (F.col("_nth") < F.col("_open")), F.col("_cap")) \
        .otherwise(F.least(F.col("_final") * F.col("_w"), F.col("_cap")))
    return per.select("_source", "source_size", target.alias("target"))


def draw(seed: int, ident) -> F.Column:
    """Uniform number in [0, 1) from 48 bits of md5(seed, id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ratio: float = 1.5, cap: float = 2.0, seed: int = 17,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``_row`` (the input row), ``_size``, ``_source_size``, ``_target``, ``_copies``."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"),
                       words_sql(text).alias("_size"))
    mix = source_targets(rows.select("_source", F.col("_size").alias("size")), weights, ratio, cap)
    mix = mix.select(F.col("_source").alias("_s"), F.col("source_size").alias("_source_size"),
                     F.col("target").alias("_target"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(seed, F.col("_id")) < rate - F.floor(rate), 1).otherwise(0)
    return (rows.join(mix, F.col("_source").eqNullSafe(F.col("_s")), "left")
            .select("_row", "_size", "_source_size", "_target", copies.cast("int").alias("_copies")))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, input columns only."""
    planned = plan(docs, **options)
    return (planned.filter("_copies > 0")
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
