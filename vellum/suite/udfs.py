"""User-function surface (UD1-UD4) and the anomaly scan over every source (JB2)."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import jobs, udf
from vellum.suite import query
from vellum.suite.anomalies import _z_sql


@query("ud1_custom_step", sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_returnflag = 'R'""")
def ud1(spark, sf):
    def my_step(df):
        return (df.filter(F.col("l_returnflag") == "R")
                .select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")))
    return udf.custom_step(spark.table("lineitem"), my_step)


def _line_stats(batches):
    for pdf in batches:
        text = pdf["text"].fillna("")
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_lines": text.str.count("\n") + 1,
                            "n_chars": text.str.len()})


@query("ud2_map_in_pandas", sql="""
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines,
       CAST(length(text) AS BIGINT) AS n_chars FROM documents""")
def ud2(spark, sf):
    return udf.per_batch(spark.table("documents").select("doc_id", "text"), _line_stats,
                         "doc_id long, n_lines long, n_chars long")


def _daily_share(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("ds")
    total = pdf["y"].sum()
    return pdf.assign(share=pdf["y"] / total, cumulative=pdf["y"].cumsum())[["user_id", "ds", "share", "cumulative"]]


USER_DAILY = "SELECT user_id, CAST(ts AS DATE) AS ds, sum(value) AS y FROM events GROUP BY user_id, CAST(ts AS DATE)"


@query("ud3_apply_in_pandas", rounds={"share": 9, "cumulative": 6}, sql=f"""
WITH u AS ({USER_DAILY})
SELECT user_id, ds, y / sum(y) OVER (PARTITION BY user_id) AS share,
       sum(y) OVER (PARTITION BY user_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
FROM u""")
def ud3(spark, sf):
    # groups are one user's days (bounded by the calendar), not raw events
    return udf.per_group(spark.sql(USER_DAILY), ["user_id"], _daily_share,
                         "user_id long, ds date, share double, cumulative double")


@F.pandas_udf(T.DoubleType())
def _range_of(v: pd.Series) -> float:
    return float(v.max() - v.min())


@query("ud4_grouped_pandas_aggregate", rounds={"daily_range": 6}, sql=f"""
WITH u AS ({USER_DAILY}) SELECT user_id, max(y) - min(y) AS daily_range FROM u GROUP BY user_id""")
def ud4(spark, sf):
    return udf.grouped_aggregate(spark.sql(USER_DAILY), ["user_id"], _range_of(F.col("y")), "daily_range")


@query("ud4_sql_aggregate", rounds={"weighted": 6}, sql="""
SELECT event_type, sum(value * user_id) / sum(user_id) AS weighted FROM events GROUP BY event_type""")
def ud4s(spark, sf):
    return spark.table("events").groupBy("event_type").agg(F.expr("sum(value * user_id) / sum(user_id)").alias("weighted"))


JB2_TABLES = {"events": ["event_id", "user_id", "value"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
              "part": ["p_partkey", "p_size", "p_retailprice"]}


@query("jb2_anomaly_scan", rounds={"mean": 6}, sql="\nUNION ALL\n".join(
    f"SELECT '{t}' AS source, * FROM ({_z_sql(t, cols, {c: 'CAST(mx AS VARCHAR)' for c in cols})})"
    for t, cols in JB2_TABLES.items()))
def jb2(spark, sf):
    scan = jobs.scan_anomalies(spark, {**dict.fromkeys(JB2_TABLES), "no_such_table": None}, spark.table)
    if scan.skipped != ["no_such_table"]:
        raise AssertionError(f"skipped {scan.skipped}")
    return scan.findings
