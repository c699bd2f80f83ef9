"""Row-order operators that stay distributed.

pandas reasons in positions ("the previous 5 rows"); a global Spark
window without ``partitionBy`` would put the whole table in one task.
Instead:

* ``with_global_index`` sorts by range partitioning, numbers rows inside
  each partition (``monotonically_increasing_id`` after a per-partition
  sort), checkpoints that (reliable checkpoint in the session's
  ``spark.checkpoint.dir``, so a lost executor does not renumber rows),
  and adds per-partition offsets from a table with one row per
  partition (a bound fixed by configuration, safe to broadcast);
* ``halo_buckets`` cuts the indexed rows into buckets of ``bucket_rows``
  and copies the last ``halo`` rows of each bucket into the next one, so
  a window partitioned by bucket sees every frame that reaches at most
  ``halo`` rows back. Copies are flagged and dropped after the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import checkpoint_dir

BUCKET_ROWS = 1_000_000


def with_global_index(df: DataFrame, order_cols: list, idx: str = "idx",
                      partitions: int | None = None) -> DataFrame:
    """Add a 0-based position ``idx`` in the order of ``order_cols`` (make the
    order total by including a unique key)."""
    checkpoint_dir(df.sparkSession)
    ordered = (df.repartitionByRange(partitions, *order_cols) if partitions
               else df.repartitionByRange(*order_cols)).sortWithinPartitions(*order_cols)
    tagged = (ordered.withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint(eager=True))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(idx, F.col("_off") + F.col("_pos"))
            .drop("_pid", "_pos", "_off"))


def running_total(df: DataFrame, order_cols: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to this one in the
    order of ``order_cols`` (a total order). Sums run inside range partitions;
    what earlier partitions add comes from a table of one row per partition."""
    checkpoint_dir(df.sparkSession)
    tagged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    total, rows = 0, []
    for r in sorted(tagged.groupBy("_pid").agg(F.sum(value).alias("_sum")).collect()):  # one row per partition
        rows.append((r["_pid"], total))
        total += r["_sum"]
    offsets = df.sparkSession.createDataFrame(rows, "_pid int, _off long")
    inside = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.sum(value).over(inside)).drop("_pid", "_off"))


def halo_buckets(indexed: DataFrame, halo: int, idx: str = "idx", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows with ``_bucket`` and ``_halo``; window by ``_bucket`` ordered by ``idx``."""
    if halo >= bucket_rows:
        raise ValueError("halo must be smaller than bucket_rows")
    b = F.floor(F.col(idx) / bucket_rows)
    main = indexed.withColumn("_bucket", b).withColumn("_halo", F.lit(False))
    copies = (indexed.filter(F.col(idx) % bucket_rows >= bucket_rows - halo)
              .withColumn("_bucket", b + 1).withColumn("_halo", F.lit(True)))
    return main.unionByName(copies)


def rolling(df: DataFrame, value: str, order_cols: list, window: int = 5, partition_by: list | None = None,
            out: str | None = None, bucket_rows: int = BUCKET_ROWS, strategy: str = "index") -> DataFrame:
    """Rolling mean over ``window`` rows (null until the frame holds ``window``
    non-null values, as pandas ``rolling(window).mean()``) and its first
    difference ``{out}_diff``, per ``partition_by`` key when given.

    ``strategy="index"`` (default) sorts by (keys, order) with range
    partitioning, so a hot key is spread over many tasks, and runs the window
    per halo bucket; a frame or lag that would cross into another key is
    null, which is exactly the per-key result. ``strategy="window"`` uses one
    window per key (one task per key)."""
    out = out or f"{value}_rolling_mean"
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)  # NaN is missing
    keys = list(partition_by or [])
    if strategy == "window" and keys:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        wr = w.rowsBetween(-(window - 1), 0)
        res = df.withColumn(out, F.when(F.count(x).over(wr) == window, F.avg(x).over(wr)))
        return res.withColumn(f"{out}_diff", F.col(out) - F.lag(out, 1).over(w))
    indexed = with_global_index(df, keys + list(order_cols))
    hb = halo_buckets(indexed, window, bucket_rows=bucket_rows)
    w = Window.partitionBy("_bucket").orderBy("idx")
    wr = w.rowsBetween(-(window - 1), 0)
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(F.col(k), window - 1).over(w).eqNullSafe(F.col(k))
    res = hb.withColumn(out, F.when((F.count(x).over(wr) == window) & same, F.avg(x).over(wr)))
    prev_same = F.lit(True)
    for k in keys:
        prev_same = prev_same & F.lag(F.col(k), 1).over(w).eqNullSafe(F.col(k))
    res = res.withColumn(f"{out}_diff", F.when(prev_same, F.col(out) - F.lag(out, 1).over(w)))
    return res.filter(~F.col("_halo")).drop("_bucket", "_halo")


def previous_in_key(df: DataFrame, columns: list[str], order_cols: list, keys: list | None = None,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``prev_<c>`` for each column: the value on the previous row of the same
    key in order (null on a key's first row), skew-safe as ``rolling``."""
    keys = list(keys or [])
    indexed = with_global_index(df, keys + list(order_cols))
    hb = halo_buckets(indexed, 1, bucket_rows=bucket_rows)
    w = Window.partitionBy("_bucket").orderBy("idx")
    same = F.lit(True)
    for k in keys:
        same = same & F.lag(F.col(k), 1).over(w).eqNullSafe(F.col(k))
    for c in columns:
        hb = hb.withColumn(f"prev_{c}", F.when(same, F.lag(F.col(c), 1).over(w)))
    return hb.filter(~F.col("_halo")).drop("_bucket", "_halo")


def lags(df: DataFrame, column: str, steps: list[int], order_cols: list, keys: list | None = None,
         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``lag_<k>`` for every k of ``steps``: the value k rows back in the same
    key's order (null where the key has no such row), skew-safe as ``rolling``."""
    keys = list(keys or [])
    indexed = with_global_index(df, keys + list(order_cols))
    hb = halo_buckets(indexed, max(steps), bucket_rows=bucket_rows)
    w = Window.partitionBy("_bucket").orderBy("idx")
    for k in steps:
        same = F.lag("idx", k).over(w).isNotNull()
        for key in keys:
            same = same & F.lag(F.col(key), k).over(w).eqNullSafe(F.col(key))
        hb = hb.withColumn(f"lag_{k}", F.when(same, F.lag(F.col(column), k).over(w)))
    return hb.filter(~F.col("_halo")).drop("_bucket", "_halo", "idx")
