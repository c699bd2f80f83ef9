"""Queries over data past any former limit (long lists, many categories,
infinities, NaN) and over whole jobs: CSV parity, custom SQL, KPI tracking,
anomaly scans with time columns, resampling."""

from pyspark.sql import functions as F

from vellum.operators import charts, features, jobs, kpi, ordered, profile, quality
from vellum.operators import timeseries as ts
from vellum.operators.quantiles import exact_quantiles, grouped_exact_quantiles
from vellum.plans.steps import run_steps
from vellum.sources import documents, sinks
from vellum.sources.files import read_file
from vellum.suite import query
from vellum.suite.anomalies import _trend_sql, _z_sql

ALLOWED = list(range(10_001))


@query("dq6_enum_long_list", sql="""
SELECT 'parts' AS rule_name, count(*) FILTER (WHERE l_partkey > 10000 OR l_partkey < 0) AS violation_count,
       list_slice(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (WHERE l_partkey > 10000 OR l_partkey < 0)), 1, 5)
       AS sample_failures FROM (SELECT l_partkey * 7 AS l_partkey FROM lineitem)""")
def dq6_long(spark, sf):
    df = spark.table("lineitem").select((F.col("l_partkey") * 7).alias("l_partkey"))
    rule = {"rule_name": "parts", "rule_type": "enum_values", "column_name": "l_partkey", "rule_parameters": {"allowed": ALLOWED}}
    return quality.run_quality_checks(df, [rule]).select("rule_name", "violation_count", "sample_failures")


@query("dq12_custom_sql_query", sql="""
SELECT 'orphans' AS rule_name, 'failed' AS status, count(*) AS violation_count,
       list_slice(list_sort(list(DISTINCT CAST(o_custkey AS VARCHAR))), 1, 5) AS sample_failures
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def dq12_query(spark, sf):
    rule = {"rule_name": "orphans", "rule_type": "custom_sql", "column_name": "o_custkey", "rule_parameters": {
        "query": "SELECT * FROM {data} WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"}}
    return quality.run_quality_checks(spark.table("orders"), [rule]).select(
        "rule_name", "status", "violation_count", "sample_failures")


_INF = """SELECT l_returnflag, CASE WHEN l_orderkey % 10 = 0 THEN CAST('Infinity' AS DOUBLE)
WHEN l_orderkey % 10 = 1 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(l_extendedprice AS DOUBLE) END AS v FROM lineitem"""


@query("ag10_quantiles_infinity", rounds={"q25": 6, "q50": 6, "q75": 6}, sql=f"""
SELECT quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75,
       min(v) AS lo, max(v) AS hi FROM ({_INF})""")
def ag10_inf(spark, sf):
    q = exact_quantiles(spark.sql(_INF), ["v"], [0.25, 0.5, 0.75, 0.0, 1.0], median_mean=False)["v"]
    return spark.createDataFrame([tuple(q)], "q25 double, q50 double, q75 double, lo double, hi double").select(
        *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "lo", "hi")


@query("ag1_grouped_quantiles_infinity", rounds={"q0": 6, "q1": 6}, sql=f"""
SELECT l_returnflag, quantile_cont(v, 0.5) AS q0, quantile_cont(v, 0.75) AS q1 FROM ({_INF}) GROUP BY l_returnflag""")
def ag1_inf(spark, sf):
    return grouped_exact_quantiles(spark.sql(_INF), "l_returnflag", "v", [0.5, 0.75], median_mean=False)


@query("fe7_one_hot_many", sql="SELECT o_orderkey, " + ", ".join(
    f"CAST(o_custkey % 251 = {i} AS DOUBLE) AS k_{i}" for i in range(251)) + " FROM orders")
def fe7_many(spark, sf):
    df = spark.table("orders").select("o_orderkey", (F.col("o_custkey") % 251).cast("int").alias("k"))
    return features.categorical_encoding(df, ["k"], categories={"k": list(range(251))})


@query("src6_find_all", sql="SELECT event_id FROM events WHERE value >= 0")
def find_all(spark, sf):
    return documents.find(spark.table("events"), {"value": {"$gte": 0}}, {"event_id": 1})


@query("src7_first_last_sorted", sql="""
SELECT event_type AS _id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id
FROM events GROUP BY event_type""")
def first_last(spark, sf):
    return documents.aggregate(spark.table("events"), [
        {"$sort": {"ts": 1, "event_id": 1}},
        {"$group": {"_id": "$event_type", "first_id": {"$first": "$event_id"}, "last_id": {"$last": "$event_id"}}}],
        drop_id=False)


@query("src7_lookup_unwind", sql="""
SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def lookup_unwind(spark, sf):
    out = documents.aggregate(spark.table("orders"), [
        {"$lookup": {"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c"}},
        {"$unwind": "$c"}], {"customer": spark.table("customer")})
    return out.select("o_orderkey", "c.c_name")


@query("src1_csv_texts", sql=r"""
SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n_chars,
       CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'say "' || lang || '"' || chr(10) || text END AS text FROM documents""")
def csv_texts(spark, sf):
    path = sinks.scratch_path(spark, "csv-texts")
    df = spark.table("documents").selectExpr(
        "doc_id", "lang", "CASE WHEN doc_id % 5 = 0 THEN 'NA' ELSE string(n_chars) END AS n_chars",
        "CASE WHEN doc_id % 7 = 0 THEN 'NaN' ELSE 'say \"' || lang || '\"' || chr(10) || text END AS text")
    df.write.options(header="true", quote='"', escape='"', quoteAll="true").csv(path)
    return read_file(spark, path, fmt="csv").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "n_chars", "text")


_NAN = """SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 9 = 0 THEN CAST('NaN' AS DOUBLE)
ELSE CAST(value AS DOUBLE) END AS v FROM events"""
_NULLED = _NAN.replace("CAST('NaN' AS DOUBLE)", "NULL")


@query("ag3_kpis_nan", rounds={"value": 6}, sql=f"""
SELECT 'sum' AS name, coalesce(sum(v), 0) AS value FROM ({_NULLED}) UNION ALL SELECT 'mean', avg(v) FROM ({_NULLED})
UNION ALL SELECT 'unique', CAST(count(DISTINCT v) AS DOUBLE) FROM ({_NULLED})
UNION ALL SELECT 'median', median(v) FROM ({_NULLED})""")
def kpis_nan(spark, sf):
    return kpi.calculate_kpis(spark.sql(_NAN), [
        {"name": "sum", "calculation_logic": "sum 'v'"}, {"name": "mean", "calculation_logic": "mean 'v'"},
        {"name": "unique", "calculation_logic": "count_unique 'v'"}, {"name": "median", "calculation_logic": "median 'v'"}])


@query("wn1_rolling_nan", rounds={"v_rolling_mean": 6, "v_rolling_mean_diff": 6}, sql=f"""
WITH r AS (SELECT event_id, CASE WHEN count(v) OVER w = 5 THEN avg(v) OVER w END AS rm, ts FROM ({_NULLED})
           WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, rm AS v_rolling_mean, rm - lag(rm) OVER (ORDER BY ts, event_id) AS v_rolling_mean_diff FROM r""")
def rolling_nan(spark, sf):
    df = spark.sql(_NAN).select("event_id", "ts", "v")
    return ordered.rolling(df, "v", ["ts", "event_id"], 5).select("event_id", "v_rolling_mean", "v_rolling_mean_diff")


@query("ch1_bar_nan", rounds={"v": 4}, sql=f"SELECT event_type, sum(v) AS v FROM ({_NULLED}) GROUP BY event_type")
def bar_nan(spark, sf):
    return charts.chart_data(spark.sql(_NAN), "bar", x="event_type", y="v")


@query("ag13_unique_counts_nan", sql=f"""
SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS unique_count FROM ({_NULLED})
UNION ALL SELECT 'v', count(DISTINCT v) FROM ({_NULLED})""")
def unique_nan(spark, sf):
    return profile.unique_counts(spark.sql(_NAN).select("event_type", "v"))


JB2_TIMES = {"customer": None, "events": {"time_column": "ts", "tie_breaker": ["event_id"]}}


@query("jb2_anomaly_scan_times", rounds={"mean": 6}, sql="\nUNION ALL\n".join([
    f"SELECT 'customer' AS source, * FROM ({_z_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'], {c: 'CAST(mx AS VARCHAR)' for c in ('c_custkey', 'c_nationkey', 'c_acctbal')})})",
    f"SELECT 'events' AS source, * FROM ({_z_sql('events', ['event_id', 'user_id', 'value'], {c: 'CAST(mx AS VARCHAR)' for c in ('event_id', 'user_id', 'value')})})",
    f"SELECT 'events' AS source, * FROM ({_trend_sql('events', 'event_id', 'ts, event_id')})"]))
def scan_times(spark, sf):
    return jobs.scan_anomalies(spark, JB2_TIMES, spark.table).findings


TRACKED = [(1, "lines", "count", None, None), (1, "quantity", "sum 'l_quantity'", 1.0, None),
           (2, "discount", "mean 'l_discount'", None, 0.5), (2, "bad", "mean 'nope'", 1.0, 0.0)]


@query("kp2_track_all_active", rounds={"value": 6, "previous_value": 6, "delta": 6}, sql="""
WITH a AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT 1 AS project_id, 'lines' AS name, CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS value,
       CAST((SELECT count(*) FROM a) AS DOUBLE) AS previous_value,
       CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM a) AS DOUBLE) AS delta, 1 AS trend, 'ok' AS status
UNION ALL SELECT 1, 'quantity', (SELECT sum(l_quantity) FROM lineitem), (SELECT sum(l_quantity) FROM a),
       (SELECT sum(l_quantity) FROM lineitem) - (SELECT sum(l_quantity) FROM a), 1, 'above_upper'
UNION ALL SELECT 2, 'discount', (SELECT avg(l_discount) FROM lineitem), (SELECT avg(l_discount) FROM a),
       (SELECT avg(l_discount) FROM lineitem) - (SELECT avg(l_discount) FROM a),
       CAST(sign((SELECT avg(l_discount) FROM lineitem) - (SELECT avg(l_discount) FROM a)) AS INTEGER), 'below_lower'
UNION ALL SELECT 2, 'bad', NULL, NULL, NULL, NULL, NULL""")
def track_all(spark, sf):
    rows = [(p, n, None, "expression", logic, None, up, low, True) for p, n, logic, up, low in TRACKED]
    rows.append((1, "off", None, "expression", "count", None, None, None, False))
    definitions = spark.createDataFrame(rows, kpi.KPI_SCHEMA)
    path = sinks.scratch_path(spark, "kpi-history")
    half = spark.table("lineitem").filter("l_orderkey % 2 = 0")
    kpi.track_all(half, definitions, path, "run-1")
    kpi.track_all(spark.table("lineitem"), definitions, path, "run-2")
    return kpi.track_all(spark.table("lineitem"), definitions, path, "run-2")  # repeated: compares with run-1


@query("ts3_resample_daily_mean", rounds={"y": 6}, sql="""
WITH b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM events),
p AS (SELECT lo + INTERVAL 1 DAY * CAST(floor(epoch(ts - lo) / 86400) AS INTEGER) AS ds, avg(value) AS y FROM events, b GROUP BY 1),
g AS (SELECT d AS ds FROM (SELECT min(ds) AS lo, max(ds) AS hi FROM p), generate_series(lo, hi, INTERVAL 1 DAY) AS t(d))
SELECT g.ds, p.y FROM g LEFT JOIN p ON g.ds = p.ds""")
def resample_daily(spark, sf):
    return ts.resample(spark.table("events").selectExpr("ts AS ds", "value AS y"), "D", "mean")


@query("ts3_resample_month_ends", rounds={"y": 4}, sql="""
WITH p AS (SELECT last_day(o_orderdate) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY 1),
g AS (SELECT last_day(CAST(d AS DATE)) AS ds FROM (SELECT date_trunc('month', min(o_orderdate)) AS lo,
      date_trunc('month', max(o_orderdate)) AS hi FROM orders), generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
      INTERVAL 1 MONTH) AS t(d))
SELECT CAST(g.ds AS TIMESTAMP) AS ds, p.y FROM g LEFT JOIN p ON g.ds = p.ds""")
def resample_months(spark, sf):
    df = spark.table("orders").selectExpr("CAST(o_orderdate AS TIMESTAMP_NTZ) AS ds", "CAST(o_totalprice AS DOUBLE) AS y")
    return ts.resample(df, "M", "sum")


@query("prj9_column_difference", rounds={"margin": 6}, sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - l_extendedprice * l_discount AS margin FROM lineitem""")
def difference(spark, sf):
    df = spark.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice AS a",
                                            "l_extendedprice * l_discount AS b")
    return run_steps(df, [{"step_type": "column_difference", "params": {
        "column1": "a", "column2": "b", "new_column_name": "margin"}}]).drop("a", "b")


@query("prj10_column_ratio", rounds={"unit": 6}, sql="""
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_extendedprice / l_quantity END AS unit FROM lineitem""")
def ratio(spark, sf):
    df = spark.table("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice AS a",
                                            "CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_quantity END AS b")
    return run_steps(df, [{"step_type": "column_ratio", "params": {
        "column1": "a", "column2": "b", "new_column_name": "unit"}}]).drop("a", "b")


@query("cl7_datetime_layouts", sql="""
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders""")
def layouts(spark, sf):
    df = spark.table("orders").selectExpr("o_orderkey", """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'M/d/yyyy')
        WHEN 1 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 2 THEN date_format(o_orderdate, 'd MMM yyyy')
        WHEN 3 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS d""")
    return run_steps(df, [{"step_type": "convert_type", "params": {"column": "d", "target_type": "datetime"}}])
