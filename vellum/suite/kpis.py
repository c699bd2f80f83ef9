"""KPIs (KP1-KP6, AG2-AG8, WN4-WN5)."""

from pyspark.sql import functions as F

from vellum.operators import kpi
from vellum.suite import query

KPIS = [
    {"name": "lines", "calculation_logic": "count"},
    {"name": "orders", "calculation_logic": "count_unique 'l_orderkey'"},
    {"name": "quantity", "calculation_logic": "sum 'l_quantity'"},
    {"name": "avg_price", "calculation_logic": "mean 'l_extendedprice'"},
    {"name": "median_discount", "calculation_logic": "median 'l_discount'"},
    {"name": "discount_value", "calculation_logic": "sum(l_extendedprice * l_discount) / count(*)"},
    {"name": "finished_orders", "calculation_type": "sql",
     "calculation_logic": "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'"},
    {"name": "bad_column", "calculation_logic": "mean 'nope'"},
    {"name": "not_scalar", "calculation_logic": "l_quantity * 2"},
]

KPI_SQL = {
    "lines": "SELECT CAST(count(*) AS DOUBLE) FROM lineitem",
    "orders": "SELECT CAST(count(DISTINCT l_orderkey) AS DOUBLE) FROM lineitem",
    "quantity": "SELECT coalesce(sum(l_quantity), 0) FROM lineitem",
    "avg_price": "SELECT avg(l_extendedprice) FROM lineitem",
    "median_discount": "SELECT median(l_discount) FROM lineitem",
    "discount_value": "SELECT sum(l_extendedprice * l_discount) / count(*) FROM lineitem",
    "finished_orders": "SELECT CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus = 'F'",
    "bad_column": "SELECT CAST(NULL AS DOUBLE)",
    "not_scalar": "SELECT CAST(NULL AS DOUBLE)",
}


def _kpi_rows_sql(names):
    return "\nUNION ALL\n".join(f"SELECT '{n}' AS name, ({KPI_SQL[n]}) AS value" for n in names)


@query("kp2_calculate", rounds={"value": 4}, sql=_kpi_rows_sql([k["name"] for k in KPIS]))
def kp2(spark, sf):
    return kpi.calculate_kpis(spark.table("lineitem"), KPIS)


for _id, _k in zip(["ag2_kpi_count", "ag3_kpi_count_unique", "ag4_kpi_sum", "ag5_kpi_mean", "ag6_kpi_median",
                    "ag7_kpi_expression", "ag8_kpi_sql"], KPIS[:7]):
    def _mk(k=_k):
        return lambda spark, sf: kpi.calculate_kpis(spark.table("lineitem"), [k])
    query(_id, rounds={"value": 4}, sql=_kpi_rows_sql([_k["name"]]))(_mk())


@query("wn4_latest_kpi", views=["kpi_history"], rounds={"previous_value": 6}, sql="""
SELECT kpi_name, arg_max(value, run_date) AS previous_value, max(run_date) AS previous_ts
FROM kpi_history GROUP BY kpi_name""")
def wn4(spark, sf):
    return kpi.latest_values(spark.table("kpi_history"), "kpi_name", "run_date")


@query("wn5_kpi_delta_trend", views=["kpi_history"], rounds={"value": 6, "delta": 6}, sql="""
SELECT *, value - lag(value) OVER w AS delta, CAST(sign(value - lag(value) OVER w) AS INTEGER) AS trend
FROM kpi_history WINDOW w AS (PARTITION BY kpi_name ORDER BY run_date)""")
def wn5(spark, sf):
    return kpi.history_trend(spark.table("kpi_history"), "kpi_name", "run_date")


@query("kp3_track", views=["kpi_history"], rounds={"value": 6, "previous_value": 6, "delta": 6}, sql="""
WITH last AS (SELECT max(run_date) AS d FROM kpi_history),
cur AS (SELECT kpi_name, value FROM kpi_history WHERE run_date = (SELECT d FROM last)),
prev AS (SELECT kpi_name, arg_max(value, run_date) AS previous_value FROM kpi_history
         WHERE run_date < (SELECT d FROM last) GROUP BY kpi_name)
SELECT cur.kpi_name, value, previous_value, value - previous_value AS delta,
       CAST(sign(value - previous_value) AS INTEGER) AS trend
FROM cur LEFT JOIN prev ON cur.kpi_name = prev.kpi_name""")
def kp3(spark, sf):
    h = spark.table("kpi_history")
    last = h.select(F.max("run_date")).scalar()
    current = h.filter(F.col("run_date") == last).select("kpi_name", "value")
    history = h.filter(F.col("run_date") < last)
    return kpi.track(current, history, "kpi_name", "run_date")


@query("kp4_threshold_status", views=["kpi_history"], sql="""
SELECT kpi_name, run_date, CASE WHEN value > 800 THEN 'above_upper' WHEN value < 500 THEN 'below_lower' ELSE 'ok' END
       AS status FROM kpi_history""")
def kp4(spark, sf):
    h = spark.table("kpi_history")
    return h.select("kpi_name", "run_date", kpi.threshold_status(F.col("value"), 800.0, 500.0).alias("status"))


@query("kp5_target_distance", views=["kpi_history"], rounds={"to_target": 9}, sql="""
SELECT kpi_name, run_date, (value - 600.0) / 600.0 AS to_target, (value - 0.0) / NULLIF(0.0, 0.0) AS to_zero_target
FROM kpi_history""")
def kp5(spark, sf):
    h = spark.table("kpi_history")
    return h.select("kpi_name", "run_date", kpi.target_distance(F.col("value"), 600.0).alias("to_target"),
                    kpi.target_distance(F.col("value"), 0.0).alias("to_zero_target"))


@query("kp6_format_value", views=["kpi_history"], sql="""
SELECT kpi_name, run_date, '$' || format('{:,.2f}', value * 1000) AS currency,
       format('{:.2f}%', value / 1000 * 100) AS percentage, format('{:,.2f}', value * 1000) AS number,
       format('{:,}', CAST(floor(value) AS BIGINT) * 1000) AS whole
FROM kpi_history""")
def kp6(spark, sf):
    h = spark.table("kpi_history")
    return h.select("kpi_name", "run_date",
                    kpi.format_value(F.col("value") * 1000, "currency").alias("currency"),
                    kpi.format_value(F.col("value") / 1000, "percentage").alias("percentage"),
                    kpi.format_value(F.col("value") * 1000, "number").alias("number"),
                    kpi.format_value(F.floor("value").cast("long") * 1000, "number", is_integer=True).alias("whole"))
