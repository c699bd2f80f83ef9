"""Readers (SRC1, SRC2, SRC8) and append sinks (SNK1-SNK4).

The files read here are written first from the test tables into a fresh
folder under the session's checkpoint directory.
"""

from pyspark.sql import functions as F

from vellum.operators import kpi, quality
from vellum.plans.steps import append_lineage, run_steps
from vellum.sources import sinks
from vellum.sources.files import read_file, with_source
from vellum.suite import query
from vellum.suite.kpis import KPIS, _kpi_rows_sql
from vellum.suite.quality import LI_RULES, oracle_rules


@query("src1_csv_scan", sql="""
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def src1(spark, sf):
    path = sinks.scratch_path(spark, "csv")
    spark.table("customer").write.option("header", "true").csv(path)
    return read_file(spark, path, fmt="csv")


@query("src2_json_scan", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src2(spark, sf):
    path = sinks.scratch_path(spark, "json") + ".json"
    spark.table("customer").write.json(path)
    df = read_file(spark, path)
    return df.select(F.col("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"),
                     "c_acctbal", "c_mktsegment")


@query("src8_source_provenance", sql="SELECT 'orders.parquet' AS file, count(*) AS n FROM orders")
def src8(spark, sf):
    df = with_source(spark.read.parquet(f"{sf}/orders.parquet"))
    return df.groupBy(F.regexp_extract("source_uri", r"([^/]+)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query("snk1_violation_log", sql=f"""
SELECT r.*, CAST(i.rid AS BIGINT) AS rule_id, 'run-1' AS run_id
FROM ({oracle_rules('lineitem', LI_RULES, 'lineitem')}) r
JOIN (VALUES ('qty_min', 2), ('qty_max', 3), ('flag_enum', 4), ('status_regex', 5), ('price_len', 7), ('key_unique', 8),
             ('qty_not_null', 1), ('flag_len', 6)) i(name, rid) ON r.rule_name = i.name
WHERE status IN ('failed', 'error')""")
def snk1(spark, sf):
    path = sinks.scratch_path(spark, "violations")
    res = quality.run_quality_checks(spark.table("lineitem"), LI_RULES, source="lineitem")
    ids = {r["rule_name"]: i + 1 for i, r in enumerate(LI_RULES)}
    sinks.append_violations(res, path, "run-1", ids)
    sinks.append_violations(res, path, "run-1", ids)  # a replayed run replaces its rows
    return sinks.read_table(spark, path).drop("check_timestamp")


@query("snk2_kpi_history", rounds={"value": 4}, sql=f"""
SELECT name, TIMESTAMP '2024-02-01 00:00:00' AS run_ts, value, run_id FROM (
  SELECT *, 'r1' AS run_id FROM ({_kpi_rows_sql([k['name'] for k in KPIS[:5]])})
  UNION ALL SELECT *, 'r2' FROM ({_kpi_rows_sql([k['name'] for k in KPIS[:5]])}))""")
def snk2(spark, sf):
    path = sinks.scratch_path(spark, "kpi-values")
    import datetime as dt
    vals = kpi.calculate_kpis(spark.table("lineitem"), KPIS[:5])
    for run in ("r1", "r2"):
        sinks.append_kpi_values(vals, path, run, dt.datetime(2024, 2, 1))
    return sinks.read_table(spark, path).withColumn("run_ts", F.col("run_ts").cast("timestamp_ntz"))


LINEAGE_STEPS = [
    {"step_type": "impute_missing", "params": {"column": "o_orderpriority", "strategy": "drop_rows"}},
    {"step_type": "date_extraction", "params": {"column": "o_orderdate", "components": ["year"]}},
    {"step_type": "numeric_interaction", "params": {"column1": "o_totalprice", "column2": "o_custkey"}},
    {"step_type": "binning", "params": {"bins": 4, "column": "o_totalprice"}},
    {"step_type": "categorical_encoding", "params": {"columns": ["o_orderstatus"]}},
    {"step_type": "drop_duplicates", "params": {"subset": ["o_custkey"], "keep": False}},
]


@query("snk3_lineage", views=["orders_nulls"], sql="""
SELECT step_no, process_type, step_type, params, new_columns,
       coalesce(lag(rows_out) OVER (ORDER BY step_no), (SELECT count(*) FROM orders_nulls)) AS rows_in, rows_out FROM (VALUES
 (1, 'cleaning', 'impute_missing', '{"column": "o_orderpriority", "strategy": "drop_rows"}', CAST([] AS VARCHAR[]),
  (SELECT count(*) FROM orders_nulls WHERE o_orderpriority IS NOT NULL)),
 (2, 'feature_engineering', 'date_extraction', '{"column": "o_orderdate", "components": ["year"]}', ['o_orderdate_year'],
  (SELECT count(*) FROM orders_nulls WHERE o_orderpriority IS NOT NULL)),
 (3, 'feature_engineering', 'numeric_interaction', '{"column1": "o_totalprice", "column2": "o_custkey"}',
  ['o_totalprice_mul_o_custkey'], (SELECT count(*) FROM orders_nulls WHERE o_orderpriority IS NOT NULL)),
 (4, 'feature_engineering', 'binning', '{"bins": 4, "column": "o_totalprice"}', ['o_totalprice_binned_quantile'],
  (SELECT count(*) FROM orders_nulls WHERE o_orderpriority IS NOT NULL)),
 (5, 'feature_engineering', 'categorical_encoding', '{"columns": ["o_orderstatus"]}',
  ['o_orderstatus_F', 'o_orderstatus_O', 'o_orderstatus_P'], (SELECT count(*) FROM orders_nulls WHERE o_orderpriority IS NOT NULL)),
 (6, 'cleaning', 'drop_duplicates', '{"keep": false, "subset": ["o_custkey"]}', CAST([] AS VARCHAR[]),
  (SELECT count(*) FROM (SELECT o_custkey FROM orders_nulls WHERE o_orderpriority IS NOT NULL GROUP BY o_custkey
                         HAVING count(*) = 1)))
) AS t(step_no, process_type, step_type, params, new_columns, rows_out)""")
def snk3(spark, sf):
    lineage = []
    run_steps(spark.table("orders_nulls"), LINEAGE_STEPS, lineage=lineage)
    path = sinks.scratch_path(spark, "lineage")
    for _ in range(2):  # a repeated run replaces its rows
        append_lineage(spark, lineage, path, "run-1")
    return sinks.read_table(spark, path).drop("run_id", "ts")


@query("snk4_catalog_refresh", sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_share, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count FROM {t}"
    for t, cols in {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                               "o_orderpriority"],
                    "region": ["r_regionkey", "r_name"]}.items() for c in cols))
def snk4(spark, sf):
    path = sinks.scratch_path(spark, "catalog")
    rows = sinks.catalog_rows({"orders": spark.table("orders"), "region": spark.table("region")})
    sinks.append(rows, path, "run-1")
    return sinks.read_table(spark, path).select("name", "column_name", "null_share", "distinct_count")


@query("snk4_catalog_entries", sql="""
SELECT 'orders' AS name, 'file' AS source_type, CAST([] AS VARCHAR[]) AS tags, count(*) AS rows, 6 AS schema_columns FROM orders
UNION ALL SELECT 'lineitem', 'file', CAST([] AS VARCHAR[]), count(*), 11 FROM lineitem
UNION ALL SELECT 'events', 'file', ['stream', 'clicks'], count(*), 6 FROM events""")
def snk4e(spark, sf):
    path = sinks.scratch_path(spark, "catalog-entries")
    rows = sinks.catalog_entries({t: spark.table(t) for t in ("orders", "lineitem", "events")},
                                 tags={"events": ["stream", "clicks"]})
    sinks.append(rows, path, "run-1")
    return sinks.read_table(spark, path).select("name", "source_type", "tags", "rows",
                                                F.size("schema_cache").alias("schema_columns"))


SKETCHED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("snk4_catalog_sketches", views=["orders_nulls"], sql="\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing, true AS within_bound FROM orders_nulls"
    for c in SKETCHED))
def snk4s(spark, sf):
    """Two parts are sketched one after the other and merged."""
    from vellum.operators import sketches
    path, orders = sinks.scratch_path(spark, "sketches"), spark.table("orders_nulls")
    for part in (0, 1):
        sketches.refresh(orders.filter(F.col("o_orderkey") % 2 == part), path, "orders", str(part))
    found = sketches.summary(spark.read.parquet(path))
    exact = orders.select(F.struct(*[F.count_distinct(c).alias(c) for c in SKETCHED]).alias("d")).scalar()
    n = F.coalesce(*[F.when(F.col("column_name") == c, exact[c]) for c in SKETCHED])
    close = F.abs(F.col("distinct_count") - n) <= F.when(n <= 1 << sketches.LG_NOMINAL, 0).otherwise(n * sketches.bound())
    return found.select("column_name", "rows", "missing", close.alias("within_bound"))
