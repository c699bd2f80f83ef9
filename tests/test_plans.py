"""Plan properties the scale design relies on (read from the physical plan)."""


from pyspark.sql import functions as F

from vellum.operators import clean, features, ordered, quality, suggest
from vellum.plans.steps import run_steps

LI = "/root/testdata/sf0.001/lineitem.parquet"


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_step_list_pushes_filter_and_prunes_columns(spark):
    li = spark.read.parquet(LI)
    out = run_steps(li, [{"step_type": "impute_missing", "params": {"column": "l_tax", "strategy": "drop_rows"}},
                         {"step_type": "drop_column", "params": {"column": "l_comment"}}
                         if "l_comment" in li.columns else
                         {"step_type": "change_case", "params": {"column": "l_returnflag", "case": "lower"}}])
    plan = _plan(out.select("l_orderkey", "l_returnflag"))
    assert "PushedFilters: [IsNotNull(l_tax)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double,l_returnflag:string>" in plan


def test_row_rules_share_one_aggregation(spark):
    li = spark.read.parquet(LI)
    rules = [{"rule_type": "not_null", "column_name": "l_tax"},
             {"rule_type": "min_value", "column_name": "l_quantity", "rule_parameters": {"min": 3}},
             {"rule_type": "max_length", "column_name": "l_returnflag", "rule_parameters": {"max": 1}}]
    prepared = quality.prepare_rules(li, rules)
    counts = quality._counts(li, prepared, {})
    plan = _plan(counts)
    final = plan.split("== Initial Plan ==")[0] if "== Initial Plan ==" in plan else plan
    assert final.count("FileScan parquet") == 1


def test_group_transform_combines_before_shuffle(spark):
    li = spark.read.parquet(LI)
    plan = _plan(features.grouped_aggregation(li, "l_returnflag", "l_quantity", "mean"))
    assert "partial_avg" in plan


def test_duplicates_by_key_use_aggregation_not_window(spark):
    li = spark.read.parquet(LI)
    plan = _plan(clean.drop_duplicates(li, subset=["l_orderkey"], order_by=["l_linenumber"]))
    assert "Window" not in plan and "partial_min_by" in plan


def test_rolling_has_no_unpartitioned_window(spark):
    li = spark.read.parquet(LI).select("l_orderkey", "l_linenumber", "l_quantity")
    plan = _plan(ordered.rolling(li, "l_quantity", ["l_orderkey", "l_linenumber"], 5, bucket_rows=500))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        # data windows run per bucket; the only other window numbers the partitions
        # (one row per partition: the offsets table)
        assert "_bucket" in line or "_pid" in line


def test_no_suggestions_row(spark):
    df = spark.createDataFrame([(1,)], "x int")  # constant numeric column: nothing usable
    rows = suggest.suggest_features(df).collect()
    assert [r.step_type for r in rows] == ["No Suggestions"]


def test_hot_key_spreads_over_partitions(spark):
    """Range partitioning on (key, order) splits a key holding a third of the rows."""
    rows = [(0 if i % 3 == 0 else i % 50 + 1, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, i int")
    parts = (df.repartitionByRange(8, "k", "i").select(F.spark_partition_id().alias("p"), "k")
             .filter("k = 0").select("p").distinct().count())
    assert parts >= 2


def test_pca_without_scaling_is_centred(spark):
    from vellum.operators import segments
    rows = [(float(i), float(i * 2 + 100)) for i in range(30)]
    seg = segments.find_segments(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 2, scale_data=False)
    pcs = [r.pc1 for r in seg.projection.collect()]
    assert abs(sum(pcs)) < 1e-6


def test_recommended_conf_bounds():
    from vellum.session import recommended_conf
    big = recommended_conf(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 50_000
    small = recommended_conf(10 * 2**20, 16)
    assert int(small["spark.sql.shuffle.partitions"]) == 32
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_suggestions_of_a_wide_text_column(spark):
    """Past the width the proposals stay; the encoding takes the vector form."""
    for n, method in ((200, "one-hot"), (201, "one-hot-vector")):
        df = spark.createDataFrame([(f"c{i}", float(i)) for i in range(n)], "c string, x double")
        rows = {r.step_type: r.params for r in suggest.suggest_features(df).collect()}
        assert set(rows) == {"grouped_aggregation", "binning", "categorical_encoding"}
        assert rows["categorical_encoding"]["method"] == method
