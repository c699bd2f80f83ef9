"""Anomalies (AN1-AN4), rolling windows (WN1-WN2) and the anomaly scan job (JB2)."""

from pyspark.sql import functions as F

from vellum.operators import anomalies, ordered
from vellum.suite import query


def _z_sql(table, cols, typed_max):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT 'Statistical Outlier' AS type, '{c}' AS column_name,
  k || ' potential outliers detected in ''{c}'' (Z-score > 3.0). Max value: ' || {typed_max[c]} || ', Mean: '
     || printf('%.2f', m) || '.' AS details, 'Medium' AS severity, CAST(k AS BIGINT) AS outlier_count, m AS mean,
  CAST(mx AS DOUBLE) AS max
FROM (SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS s, max({c}) AS mx,
        count(*) FILTER (WHERE abs(({c} - (SELECT avg({c}) FROM {table})) / (SELECT stddev_samp({c}) FROM {table})) > 3)
        AS k FROM {table})
WHERE n >= 10 AND s > 0 AND k > 0""")
    return "\nUNION ALL\n".join(parts)


EV_NUM = {"event_id": "CAST(mx AS VARCHAR)", "user_id": "CAST(mx AS VARCHAR)", "value": "CAST(mx AS VARCHAR)"}


@query("an1_zscore", views=["events_nulls"], rounds={"mean": 6}, sql=_z_sql("events_nulls", list(EV_NUM), EV_NUM))
def an1(spark, sf):
    return anomalies.zscore_anomalies(spark.table("events_nulls"))


LI_Z = {c: "CAST(mx AS VARCHAR)" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                          "l_extendedprice", "l_discount", "l_tax"]}


@query("an1_zscore_lineitem", rounds={"mean": 6}, sql=_z_sql("lineitem", list(LI_Z), LI_Z))
def an1l(spark, sf):
    return anomalies.zscore_anomalies(spark.table("lineitem"))


@query("an1_outlier_rows", rounds={"z": 9}, sql="""
SELECT *, (value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) AS z FROM events
WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events)) > 3""")
def an1r(spark, sf):
    return anomalies.outliers(spark.table("events"), "value")


ROLL_SQL = """
WITH r AS (
  SELECT event_id, ts, value,
    CASE WHEN count(value) OVER w5 = 5 THEN avg(value) OVER w5 END AS rm
  FROM {t} WINDOW w5 AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, ts, value, rm AS value_rolling_mean,
       rm - lag(rm) OVER (ORDER BY ts, event_id) AS value_rolling_mean_diff FROM r"""


@query("wn1_rolling_mean_global", views=["events_nulls"], rounds={"value_rolling_mean": 6, "value_rolling_mean_diff": 6},
       sql=ROLL_SQL.format(t="events_nulls"))
def wn1(spark, sf):
    df = spark.table("events_nulls").select("event_id", "ts", "value")
    # small buckets so that the test crosses many bucket boundaries
    return ordered.rolling(df, "value", ["ts", "event_id"], 5, bucket_rows=97).drop("idx")


@query("wn2_rolling_diff_daily", views=["events_daily"], rounds={"y_rolling_mean": 6, "y_rolling_mean_diff": 6}, sql="""
WITH r AS (SELECT ds, y, CASE WHEN count(y) OVER w = 5 THEN avg(y) OVER w END AS rm FROM events_daily
           WINDOW w AS (ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT ds, y, rm AS y_rolling_mean, rm - lag(rm) OVER (ORDER BY ds) AS y_rolling_mean_diff FROM r""")
def wn2(spark, sf):
    df = spark.table("events_daily").select("ds", "y")
    return ordered.rolling(df, "y", ["ds"], 5, bucket_rows=7).drop("idx")


@query("wn1_rolling_mean_per_user", rounds={"value_rolling_mean": 6, "value_rolling_mean_diff": 6}, sql="""
WITH r AS (SELECT event_id, user_id, ts, value, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS rm
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, value, rm AS value_rolling_mean,
       rm - lag(rm) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_rolling_mean_diff
FROM r""")
def wn1u(spark, sf):
    df = spark.table("events").select("event_id", "user_id", "ts", "value")
    # small buckets: the test crosses bucket and user boundaries many times
    return ordered.rolling(df, "value", ["ts", "event_id"], 5, partition_by=["user_id"], bucket_rows=101).drop("ts", "idx")


def _trend_sql(t, target, order):
    return f"""
WITH r AS (SELECT {target} AS x, {order} AS o1, CASE WHEN count({target}) OVER w = 5 THEN avg({target}) OVER w END AS rm,
                  row_number() OVER (ORDER BY {order}) AS i
           FROM {t} WINDOW w AS (ORDER BY {order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
d AS (SELECT i, rm - lag(rm) OVER (ORDER BY i) AS diff FROM r),
s AS (SELECT count(*) AS n, stddev_samp(diff) AS sd, arg_max(diff, i) AS last FROM d)
SELECT 'Trend Change' AS type, '{target}' AS column_name,
  'Significant recent ' || CASE WHEN last > 0 THEN 'increase' ELSE 'decrease' END
  || ' detected in rolling average for ''{target}'' (Change: ' || printf('%.2f', last) || ', StdDev: '
  || printf('%.2f', sd) || ').' AS details, 'Medium' AS severity, CAST(NULL AS BIGINT) AS outlier_count,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS max
FROM s WHERE n > 10 AND sd > 0 AND abs(last) > 2.5 * sd"""


@query("an2_trend_change", views=["events_daily"], sql=_trend_sql("events_daily", "y", "ds"))
def an2(spark, sf):
    df = spark.table("events_daily").select("ds", "y", "n")
    return anomalies.trend_change(df, "ds", "y")


@query("an2_trend_change_events", sql=_trend_sql("events", "event_id", "ts, event_id"))
def an2e(spark, sf):
    return anomalies.trend_change(spark.table("events"), "ts", tie_breaker=["event_id"])


def _drift_side(t):
    cols = {"event_id": True, "ts": False, "user_id": True, "event_type": False, "value": True, "props": False}
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, {('avg(' + c + ')') if num else 'CAST(NULL AS DOUBLE)'} AS mean, "
        f"count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_share FROM {t}" for c, num in cols.items())


@query("an3_snapshot_drift", rounds={"mean_before": 6, "mean_now": 6, "mean_change": 6}, sql=f"""
WITH now AS (SELECT * FROM events), before AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'),
a AS ({_drift_side('now')}), b AS ({_drift_side('before')})
SELECT column_name, b.rows AS rows_before, a.rows AS rows_now, b.mean AS mean_before, a.mean AS mean_now,
       a.mean - b.mean AS mean_change, b.null_share AS null_share_before, a.null_share AS null_share_now
FROM a JOIN b USING (column_name)""")
def an3(spark, sf):
    now = spark.table("events")
    before = now.filter(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return anomalies.snapshot_drift(now, before)


@query("an4_findings_table", views=["events_nulls"], rounds={"mean": 6}, sql=_z_sql("events_nulls", list(EV_NUM), EV_NUM)
       + "\nUNION ALL\nSELECT * FROM (" + _trend_sql("events_nulls", "event_id", "ts, event_id") + ")")
def an4(spark, sf):
    return anomalies.find_anomalies(spark.table("events_nulls"), time_column="ts", tie_breaker=["event_id"])


MONTHLY_ORDERS = ("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS revenue, "
                  "count(*) AS orders FROM orders GROUP BY 1")


@query("an2_trend_change_monthly_orders", sql=_trend_sql(f"({MONTHLY_ORDERS}) AS mo", "revenue", "month"))
def an2m(spark, sf):
    """The last month of orders is partial: its rolling mean drops sharply."""
    return anomalies.trend_change(spark.sql(MONTHLY_ORDERS), "month")
