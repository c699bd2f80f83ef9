"""SQL pass-through conformance (SQL1-SQL24): the same question answered by
Spark (SQL text through ``run_sql`` or the DataFrame API) and by DuckDB."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.plans.sql import run_sql
from vellum.suite import query


def same(name, sql, rounds=None):
    """Register a query whose SQL text is valid in both Spark and DuckDB."""
    query(name, sql=sql, rounds=rounds)(lambda spark, sf: run_sql(spark, sql))


@query("sql1_inner_join", rounds={"revenue": 2}, sql="""
SELECT o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def sql1(spark, sf):
    li, o = spark.table("lineitem"), spark.table("orders")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .groupBy("o_orderpriority")
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                 F.count(F.lit(1)).alias("lines")))


@query("sql2_broadcast_join", sql="""
SELECT r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def sql2(spark, sf):
    c, n, r = spark.table("customer"), spark.table("nation"), spark.table("region")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .groupBy("r_name").agg(F.count(F.lit(1)).alias("customers")))


same("sql3_left_join", """
SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders
  ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-02-01 00:00:00'
GROUP BY c_custkey""")

same("sql3_right_join", """
SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01 00:00:00') o
RIGHT JOIN customer ON c_custkey = o_custkey""")

same("sql3_full_join", """
SELECT a.k AS left_key, b.k AS right_key FROM (SELECT c_custkey AS k FROM customer) a
FULL OUTER JOIN (SELECT s_suppkey + (SELECT max(c_custkey) FROM customer) - 10 AS k FROM supplier) b ON a.k = b.k""")


@query("sql4_semi_join", sql="""
SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)""")
def sql4(spark, sf):
    li = spark.table("lineitem").filter("l_quantity = 50")
    o = spark.table("orders")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi")


@query("sql5_anti_join", sql="""
SELECT * FROM customer c WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND year(o_orderdate) = 1995)""")
def sql5(spark, sf):
    o = spark.table("orders").filter(F.year("o_orderdate") == 1995)
    c = spark.table("customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


BANDS = "(VALUES (1, 0.0, 920.0), (2, 920.0, 940.0), (3, 940.0, 960.0), (4, 960.0, 980.0), (5, 980.0, 1e9))"

same("sql6_range_join", f"""
SELECT band, count(*) AS parts, min(p_retailprice) AS lowest FROM part
JOIN {BANDS} AS b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi GROUP BY band""")

same("sql8_group_having", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, min(l_extendedprice) AS min_price,
       max(l_discount) AS max_disc
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1000""")


@query("sql9_distinct_aggregates", sql="""
SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS events FROM events GROUP BY event_type""")
def sql9(spark, sf):
    return spark.table("events").groupBy("event_type").agg(
        F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("events"))


same("sql10_grouping_sets", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders
GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""", rounds={"total": 2})

same("sql11_cube", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")


@query("sql12_rollup", sql="""
SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def sql12(spark, sf):
    c, n, r = spark.table("customer"), spark.table("nation"), spark.table("region")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, F.col("n_regionkey") == r.r_regionkey)
            .rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers")))


@query("sql13_ranking", sql="""
SELECT o_orderkey, o_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rnk,
  CAST(dense_rank() OVER w AS INTEGER) AS drnk, CAST(ntile(4) OVER w AS INTEGER) AS quartile
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
def sql13(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return spark.table("orders").select(
        "o_orderkey", "o_custkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rnk"),
        F.dense_rank().over(w).alias("drnk"), F.ntile(4).over(w).alias("quartile"))


same("sql14_analytic", """
SELECT event_id, user_id, lag(value) OVER w AS prev_value, lead(value, 2) OVER w AS next2_value,
       first_value(event_type) OVER w AS first_type, last_value(event_type) OVER w AS last_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")

same("sql15_frames", """
SELECT event_id, user_id,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS week_sum
FROM events""", rounds={"running": 2, "week_sum": 2})

same("sql16_union", """
SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier""")

same("sql16_union_all", """
SELECT c_nationkey AS nationkey, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier""")

same("sql17_intersect", """
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995
INTERSECT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996""")

same("sql18_except", """
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995
EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996""")


@query("sql19_order_limit_offset", sql="""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10""")
def sql19(spark, sf):
    return (spark.table("orders").select("o_orderkey", "o_totalprice")
            .orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(10).limit(10))


same("sql20_correlated_subquery", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")

same("sql21_cte", """
WITH monthly AS (
  SELECT CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mo, sum(o_totalprice) AS revenue
  FROM orders GROUP BY 1, 2),
yearly AS (SELECT yr, count(*) AS months, max(revenue) AS best, min(revenue) AS worst FROM monthly GROUP BY yr)
SELECT * FROM yearly""", rounds={"best": 2, "worst": 2})

same("sql22_functions", """
SELECT p_partkey,
  CASE WHEN p_retailprice < 930 THEN 'low' WHEN p_retailprice < 960 THEN 'mid' ELSE 'high' END AS band,
  upper(p_brand) AS brand, substr(p_name, 1, 5) AS prefix, CAST(length(p_name) AS INT) AS name_len,
  abs(p_retailprice - 1000.0) AS dist, round(sqrt(p_size), 9) AS root, round(ln(p_retailprice), 9) AS lnp,
  p_size % 7 AS size_mod
FROM part""")

same("sql22_date_functions", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS yr, CAST(month(o_orderdate) AS INT) AS mo,
  CAST(dayofmonth(o_orderdate) AS INT) AS dom, CAST(o_orderdate AS DATE) AS d,
  date_add(CAST(o_orderdate AS DATE), 30) AS due
FROM orders""")


@query("sql23_json_field", sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def sql23(spark, sf):
    return run_sql(spark, "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events")


@query("sql24_array_column", rounds={"total": 5, "dot": 5}, sql="""
SELECT vec_id, CAST(len(embedding) AS INT) AS dims, CAST(embedding[1] AS DOUBLE) AS first,
  list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) AS total,
  list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda a, b: a + b) AS dot
FROM embeddings""")
def sql24(spark, sf):
    e = F.col("embedding")
    return spark.table("embeddings").select(
        "vec_id", F.size(e).alias("dims"), F.element_at(e, 1).cast("double").alias("first"),
        F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("total"),
        F.aggregate(F.zip_with(e, e, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0),
                    lambda acc, x: acc + x).alias("dot"))
