"""Chart reductions (CH1-CH13) and segmentation (SG1-SG7, FLT2, JN4, AG16)."""

from pyspark.sql import functions as F

from vellum.operators import charts, segments
from vellum.suite import query


@query("ch1_bar", sql="""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def ch1(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "bar", x="l_returnflag", y="l_quantity", color="l_linestatus")


@query("ch2_line", rounds={"o_totalprice": 2}, sql="""
SELECT o_orderdate, sum(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderdate""")
def ch2(spark, sf):
    return charts.chart_data(spark.table("orders"), "line", x="o_orderdate", y="o_totalprice")


@query("ch2_line_bucketed", rounds={"l_quantity": "f", "l_extendedprice": "f"}, sql="""
WITH p AS (SELECT l_quantity, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY l_quantity),
s AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM p)
SELECT CAST(coalesce(least(floor((l_quantity - lo) / w), 9), 0) AS INTEGER) AS bucket, avg(l_quantity) AS l_quantity,
       avg(l_extendedprice) AS l_extendedprice FROM p, s GROUP BY 1""")
def ch2b(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "line", x="l_quantity", y="l_extendedprice", max_points=10)


@query("ch3_scatter_sample", sql="""
SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem
ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 1000""")
def ch3(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "scatter", x="l_quantity", y="l_extendedprice",
                             color="l_returnflag", max_points=1000, key=["l_orderkey", "l_linenumber", "l_partkey"])


@query("ch4_pie", rounds={"o_totalprice": 2, "share": "f"}, sql="""
SELECT o_orderpriority, sum(o_totalprice) AS o_totalprice, sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)
       AS share FROM orders GROUP BY o_orderpriority""")
def ch4(spark, sf):
    return charts.chart_data(spark.table("orders"), "pie", x="o_orderpriority", y="o_totalprice")


@query("ch5_histogram", sql="""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w
           FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) AS bin,
       lo + CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) * w AS lo,
       lo + (CAST(least(floor((l_extendedprice - lo) / w), 19) AS INTEGER) + 1) * w AS hi, count(*) AS count
FROM lineitem, s GROUP BY ALL""")
def ch5(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "histogram", x="l_extendedprice", bins=20)


@query("ch5_histogram_text", sql="SELECT lang AS value, count(*) AS count FROM documents GROUP BY lang")
def ch5t(spark, sf):
    return charts.chart_data(spark.table("documents"), "histogram", x="lang")


@query("ch6_box", rounds={"q1": 6, "median": 6, "q3": 6, "lower_fence": 6, "upper_fence": 6}, sql="""
WITH q AS (SELECT o_orderpriority, count(o_totalprice) AS n, quantile_cont(o_totalprice, 0.25) AS q1,
                  quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders GROUP BY o_orderpriority),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.o_orderpriority, n, q1, median, q3, lower_fence, upper_fence,
       min(CASE WHEN o_totalprice BETWEEN lower_fence AND upper_fence THEN o_totalprice END) AS whisker_low,
       max(CASE WHEN o_totalprice BETWEEN lower_fence AND upper_fence THEN o_totalprice END) AS whisker_high,
       count(*) FILTER (WHERE NOT (o_totalprice BETWEEN lower_fence AND upper_fence)) AS outliers
FROM f JOIN orders o ON f.o_orderpriority = o.o_orderpriority GROUP BY ALL""")
def ch6(spark, sf):
    return charts.chart_data(spark.table("orders"), "box", x="o_orderpriority", y="o_totalprice")


@query("ch6_box_null_group", views=["orders_nulls"], rounds={"q1": 6, "median": 6, "q3": 6, "lower_fence": 6, "upper_fence": 6}, sql="""
WITH q AS (SELECT o_orderpriority, count(o_totalprice) AS n, quantile_cont(o_totalprice, 0.25) AS q1,
                  quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders_nulls GROUP BY o_orderpriority),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.o_orderpriority, n, q1, median, q3, lower_fence, upper_fence,
       min(CASE WHEN o_totalprice BETWEEN lower_fence AND upper_fence THEN o_totalprice END) AS whisker_low,
       max(CASE WHEN o_totalprice BETWEEN lower_fence AND upper_fence THEN o_totalprice END) AS whisker_high,
       count(*) FILTER (WHERE NOT (o_totalprice BETWEEN lower_fence AND upper_fence)) AS outliers
FROM f JOIN orders_nulls o ON f.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority GROUP BY ALL""")
def ch6n(spark, sf):
    return charts.chart_data(spark.table("orders_nulls"), "box", x="o_orderpriority", y="o_totalprice")


@query("ch7_violin", sql="""
WITH s AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 10 AS w FROM events)
SELECT event_type, CAST(least(floor((value - lo) / w), 9) AS INTEGER) AS bin, count(*) AS count
FROM events, s GROUP BY ALL""")
def ch7(spark, sf):
    return charts.chart_data(spark.table("events"), "violin", x="event_type", y="value", bins=10)


@query("ch8_density_heatmap", sql="""
WITH a AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem),
b AS (SELECT min(l_discount) AS lo, (max(l_discount) - min(l_discount)) / 5 AS w FROM lineitem)
SELECT CAST(least(floor((l_quantity - a.lo) / a.w), 9) AS INTEGER) AS bin_x,
       CAST(least(floor((l_discount - b.lo) / b.w), 4) AS INTEGER) AS bin_y, count(*) AS count
FROM lineitem, a, b GROUP BY ALL""")
def ch8(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "density_heatmap", x="l_quantity", y="l_discount",
                             bins_x=10, bins_y=5)


@query("ch9_line_3d", sql="SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def ch9_line(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "line_3d", x="l_quantity", y="l_extendedprice", z="l_discount")


@query("ch4_pie_nan", rounds={"v": 2, "share": "f"}, sql="""
WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)
SELECT o_orderpriority, sum(v) AS v, sum(v) / (SELECT sum(v) FROM o) AS share FROM o GROUP BY o_orderpriority""")
def ch4_nan(spark, sf):
    o = spark.table("orders").selectExpr("o_orderpriority",
                                         "CASE WHEN o_orderkey % 7 = 0 THEN double('NaN') ELSE double(o_totalprice) END AS v")
    return charts.chart_data(o, "pie", x="o_orderpriority", y="v")


@query("ch9_scatter_3d", sql="""
SELECT l_quantity, l_extendedprice, l_discount FROM lineitem
ORDER BY md5('42:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey), l_orderkey, l_linenumber, l_partkey LIMIT 500""")
def ch9(spark, sf):
    return charts.chart_data(spark.table("lineitem"), "scatter_3d", x="l_quantity", y="l_extendedprice",
                             z="l_discount", max_points=500, key=["l_orderkey", "l_linenumber", "l_partkey"])


@query("ch10_choropleth", rounds={"c_acctbal": 2}, sql="""
SELECT c_nationkey, sum(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey""")
def ch10(spark, sf):
    return charts.chart_data(spark.table("customer"), "choropleth", x="c_nationkey", y="c_acctbal")


@query("ch11_treemap", rounds={"value": 2}, sql="""
SELECT p_brand, p_type, sum(p_retailprice) AS value, CAST(2 - bit_count(grouping(p_brand, p_type)) AS INTEGER) AS depth
FROM part GROUP BY ROLLUP (p_brand, p_type) HAVING grouping(p_brand, p_type) <> 3""")
def ch11(spark, sf):
    return charts.chart_data(spark.table("part"), "treemap", path=["p_brand", "p_type"], values="p_retailprice")


@query("ch13_axis_range_log", rounds={"log10_l_extendedprice": 9}, sql="""
SELECT l_orderkey, l_linenumber, l_extendedprice, log10(l_extendedprice) AS log10_l_extendedprice FROM lineitem
WHERE l_extendedprice >= 1000 AND l_extendedprice <= 50000 AND l_extendedprice > 0""")
def ch13(spark, sf):
    df = spark.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return charts.axis_range(df, "l_extendedprice", 1000, 50000, log=True)


# -- segmentation (checked by invariants: rows-only) --------------------------

SEG_FEATURES = ["c_acctbal", "c_nationkey"]


@query("sg3_kmeans_rows")
def sg3(spark, sf):
    return segments.find_segments(spark.table("customer"), SEG_FEATURES, 3, with_pca=False).rows


@query("sg5_segment_summary")
def sg5(spark, sf):
    return segments.find_segments(spark.table("customer"), SEG_FEATURES, 3, with_pca=False).summary


@query("sg6_pca_projection")
def sg6(spark, sf):
    return segments.find_segments(spark.table("customer"), SEG_FEATURES, 3).projection


@query("sg4_segment_with_nulls")
def sg4(spark, sf):
    """Rows with a missing feature keep a null segment (JN4, FLT2)."""
    df = spark.table("orders_nulls").select("o_orderkey", "o_totalprice", "o_custkey")
    return segments.find_segments(df, ["o_totalprice", "o_custkey"], 4, with_pca=False).rows


@query("sg2_standardised_features", rounds={"z_acctbal": 9, "z_nation": 9}, sql="""
SELECT c_custkey, (c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer) AS z_acctbal,
       (c_nationkey - (SELECT avg(c_nationkey) FROM customer)) / (SELECT stddev_pop(c_nationkey) FROM customer) AS z_nation
FROM customer""")
def sg2(spark, sf):
    out = segments.standardise(spark.table("customer"), ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", F.col("z_c_acctbal").alias("z_acctbal"), F.col("z_c_nationkey").alias("z_nation"))


@query("sg7_silhouette_by_k")
def sg7(spark, sf):
    """Silhouette (squared Euclidean) for k = 2..4: the data to choose k with."""
    rows = []
    for k in (2, 3, 4):
        seg = segments.find_segments(spark.table("customer"), SEG_FEATURES, k, with_pca=False, with_silhouette=True)
        rows.append((k, float(seg.silhouette)))
    return spark.createDataFrame(rows, "k int, silhouette double")
