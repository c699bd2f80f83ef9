"""The driver's parquet tables and the derived views used by the checks.

Views are plain SQL whose text runs unchanged in Spark SQL and DuckDB,
so the oracle can inline the very same definitions as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed view definitions (FIXTURES.md section 3).
VIEWS = {
    "orders_nulls": """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
       o_orderdate,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders""",
    "customer_dirty": """
SELECT c_custkey, c_nationkey,
       CASE WHEN c_custkey % 3 = 0 THEN chr(9) || ' ' || c_name || ' ' ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 19 = 0 THEN 'N/A' ELSE CAST(c_acctbal AS VARCHAR(32)) END AS c_acctbal_text,
       CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
FROM customer""",
    "orders_dup": """
SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0""",
    "events_nulls": """
SELECT event_id, ts, user_id,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value
FROM events""",
    "events_daily": """
SELECT CAST(ts AS DATE) AS ds, sum(value) AS y, count(*) AS n FROM events GROUP BY CAST(ts AS DATE)""",
    "events_daily_gaps": """
SELECT CAST(ts AS DATE) AS ds, sum(value) AS y FROM events
WHERE CAST(ts AS DATE) NOT IN (DATE '2024-01-05', DATE '2024-01-06', DATE '2024-01-17') GROUP BY CAST(ts AS DATE)""",
    "kpi_history": """
SELECT event_type AS kpi_name, CAST(ts AS DATE) AS run_date, sum(value) AS value FROM events GROUP BY event_type, CAST(ts AS DATE)""",
    "sales": """
SELECT l_orderkey, l_linenumber, l_returnflag AS first_name, l_linestatus AS last_name,
       l_extendedprice AS revenue, l_extendedprice * l_discount AS cost,
       l_extendedprice AS sales_amount, CASE WHEN l_partkey % 29 = 0 THEN 0 ELSE l_quantity END AS quantity
FROM lineitem""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, force: bool = False) -> None:
    """Register every base table and derived view as a temp view (once per
    session and folder: reading a parquet schema runs a small job per table)."""
    key = "vellum.registered.dir"
    if not force and spark.conf.get(key, None) == sf_dir and all(spark.catalog.tableExists(v) for v in VIEWS):
        return
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)
    spark.conf.set(key, sf_dir)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table(name)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named derived views (oracle side)."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
