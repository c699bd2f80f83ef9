"""Join-shaped operators of the reference (JN1-JN3), top-k (TK1-TK2) and KPI upsert (KP1)."""

import datetime as dt

from pyspark.sql import functions as F

from vellum.operators import kpi, quality
from vellum.sources import sinks
from vellum.suite import query
from vellum.suite.quality import LI_RULES, NULL_RULES, oracle_rules

RUNS = [dt.datetime(2024, 3, d) for d in (1, 2, 3)]
RULE_TABLE = ([dict(r, rule_id=i + 1, source="lineitem") for i, r in enumerate(LI_RULES)]
              + [dict(r, rule_id=100 + i, source="orders_nulls") for i, r in enumerate(NULL_RULES)])


def _violations(spark):
    """Three runs of the checks of two tables, as the violation log holds them."""
    parts = []
    for ts in RUNS:
        for src, rules in (("lineitem", LI_RULES), ("orders_nulls", NULL_RULES)):
            ids = {r["rule_name"]: r["rule_id"] for r in RULE_TABLE if r["source"] == src}
            res = quality.run_quality_checks(spark.table(src), rules, source=src)
            parts.append(sinks.violation_rows(res, ids, ts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("rule_id", "source", "rule_name", "status", "violation_count",
                      F.col("check_timestamp").cast("timestamp_ntz").alias("check_timestamp"))


def _rules_df(spark):
    return spark.createDataFrame([(r["rule_id"], r["source"], r["rule_name"]) for r in RULE_TABLE],
                                 "rule_id long, source string, rule_name string")


def _violations_sql():
    parts = []
    for ts in RUNS:
        for src, rules, base in (("lineitem", LI_RULES, 1), ("orders_nulls", NULL_RULES, 100)):
            ids = " ".join(f"WHEN '{r['rule_name']}' THEN {base + i}" for i, r in enumerate(rules))
            parts.append(f"""
SELECT CAST(CASE rule_name {ids} END AS BIGINT) AS rule_id, source, rule_name, status, violation_count,
       TIMESTAMP '{ts:%Y-%m-%d %H:%M:%S}' AS check_timestamp
FROM ({oracle_rules(src, rules, src)}) WHERE status IN ('failed', 'error')""")
    return "\nUNION ALL\n".join(parts)


@query("jn1_violation_history_by_source", views=["orders_nulls"], sql=f"""
SELECT * FROM ({_violations_sql()}) WHERE rule_id IN ({', '.join(str(r['rule_id']) for r in RULE_TABLE if r['source'] == 'orders_nulls')})
ORDER BY check_timestamp DESC, rule_id DESC LIMIT 8""")
def jn1(spark, sf):
    return quality.violation_history(_violations(spark), _rules_df(spark), source="orders_nulls", limit=8)


@query("jn1_violation_history_by_rule", views=["orders_nulls"], sql=f"""
SELECT * FROM ({_violations_sql()}) WHERE rule_id = 2 ORDER BY check_timestamp DESC, rule_id DESC LIMIT 50""")
def jn1r(spark, sf):
    return quality.violation_history(_violations(spark), _rules_df(spark), rule_id=2, source="orders_nulls")


@query("jn2_recent_with_two_joins", sql="""
SELECT o_orderkey, o_orderdate, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def jn2(spark, sf):
    o, c, n = spark.table("orders"), spark.table("customer"), spark.table("nation")
    first = n.select(F.min("n_name")).scalar()
    nat = n.filter(F.col("n_name") == first)
    j = o.join(c, o.o_custkey == c.c_custkey).join(nat, F.col("c_nationkey") == nat.n_nationkey)
    return (j.select("o_orderkey", "o_orderdate", "c_name", "n_name")
            .orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(10))


@query("jn3_semi_join_lookup", sql="""
SELECT DISTINCT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def jn3(spark, sf):
    n, s = spark.table("nation"), spark.table("supplier").filter("s_acctbal > 5000")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left_semi").select("n_nationkey", "n_name").distinct()


@query("tk1_most_recent_n", sql="""
SELECT event_id, ts, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def tk1(spark, sf):
    return (spark.table("events").select("event_id", "ts", "user_id", "value")
            .orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50))


@query("tk2_sort_by_time", sql="SELECT ts, event_id, value FROM events ORDER BY ts, event_id")
def tk2(spark, sf):
    return spark.table("events").select("ts", "event_id", "value").orderBy("ts", "event_id")


def _definitions(spark):
    """KPI definitions derived from the event types present in the data."""
    types = spark.table("events").select("event_type").distinct()
    return types.select(F.lit(1).alias("project_id"), F.col("event_type").alias("name"),
                        F.concat(F.lit("total value of "), F.col("event_type")).alias("description"),
                        F.lit("expression").alias("calculation_type"), F.lit("sum(value)").alias("calculation_logic"),
                        F.lit(None).cast("double").alias("target_value"),
                        F.lit(None).cast("double").alias("alert_threshold_upper"),
                        F.lit(None).cast("double").alias("alert_threshold_lower"), F.lit(True).alias("is_active"))


@query("kp1_upsert_definitions", sql="""
WITH old AS (SELECT DISTINCT 1 AS project_id, event_type AS name, 'total value of ' || event_type AS description,
                    'expression' AS calculation_type, 'sum(value)' AS calculation_logic, CAST(NULL AS DOUBLE) AS target_value,
                    CAST(NULL AS DOUBLE) AS alert_threshold_upper, CAST(NULL AS DOUBLE) AS alert_threshold_lower,
                    true AS is_active FROM events),
new AS (SELECT * FROM (VALUES (1, 'click', 'clicks', 'expression', 'count(*)', 100.0, 500.0, 10.0, true),
                              (1, 'refund', 'refunds', 'expression', 'count(*)', NULL, NULL, NULL, false))
        AS t(project_id, name, description, calculation_type, calculation_logic, target_value, alert_threshold_upper,
             alert_threshold_lower, is_active))
SELECT * FROM new UNION ALL SELECT * FROM old WHERE name NOT IN (SELECT name FROM new)""")
def kp1(spark, sf):
    updates = spark.createDataFrame([(1, "click", "clicks", "expression", "count(*)", 100.0, 500.0, 10.0, True),
                                     (1, "refund", "refunds", "expression", "count(*)", None, None, None, False)],
                                    kpi.KPI_SCHEMA)
    return kpi.upsert(_definitions(spark), updates)


@query("flt3_active_kpis_of_project", sql="""
SELECT DISTINCT event_type AS name FROM events WHERE event_type <> 'view'""")
def flt3(spark, sf):
    defs = _definitions(spark).withColumn("is_active", F.col("name") != "view")
    return kpi.active(defs, project_id=1).select("name")
