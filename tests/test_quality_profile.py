import pytest

from vellum.operators import profile, quality, relations, suggest
from vellum.sources.schema import schema_info


def _by_name(df):
    return {r.rule_name: r for r in df.collect()}


def test_is_unique_counts_distinct_duplicated_values(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,), (3,), (3,), (3,)], "v int")
    r = _by_name(quality.run_quality_checks(df, [{"rule_type": "is_unique", "column_name": "v"}]))["Rule_1"]
    assert r.violation_count == 2 and r.status == "failed" and r.sample_failures == ["1", "3"]


def test_regex_anchored_at_start_and_nulls_fail(spark):
    df = spark.createDataFrame([("AB1",), ("1AB",), (None,)], "s string")
    rules = [{"rule_type": "regex_match", "column_name": "s", "rule_parameters": {"pattern": "[A-Z]+"}}]
    assert _by_name(quality.run_quality_checks(df, rules))["Rule_1"].violation_count == 2
    nan_rule = quality.run_quality_checks(df, rules, null_literal="nan")
    assert _by_name(nan_rule)["Rule_1"].violation_count == 2


def test_statuses(spark, sample):
    rules = [{"rule_name": "a"}, {"rule_name": "b", "rule_type": "not_null", "column_name": "zzz"},
             {"rule_name": "c", "rule_type": "not_null", "column_name": "col_a"},
             {"rule_name": "d", "rule_type": "enum_values", "column_name": "col_b", "rule_parameters": {"allowed": "x"}},
             {"rule_name": "e", "rule_type": "min_length", "column_name": "col_b", "rule_parameters": {"min": 3}}]
    r = _by_name(quality.run_quality_checks(sample, rules))
    assert r["a"].status == "skipped" and r["b"].status == "error" and r["b"].violation_count is None
    assert r["c"].status == "failed" and r["c"].violation_count == 1 and r["c"].sample_failures == ["nan"]
    assert r["d"].status == "error" and r["e"].status == "passed"
    empty = quality.run_quality_checks(sample.limit(0), rules[2:3])
    assert empty.first().status == "skipped"


def test_split_quarantine(spark):
    df = spark.createDataFrame([(1, 5.0), (1, -1.0), (2, 3.0)], "k int, v double")
    rules = [{"rule_name": "pos", "rule_type": "min_value", "column_name": "v", "rule_parameters": {"min": 0}},
             {"rule_name": "uniq", "rule_type": "is_unique", "column_name": "k"}]
    good, bad = quality.split(df, rules)
    assert [r.k for r in good.collect()] == [2]
    tags = {r.v: sorted(r.failed_rules) for r in bad.collect()}
    assert tags == {5.0: ["uniq"], -1.0: ["pos", "uniq"]}


def test_profile_tables(spark, sample):
    p = profile.profile(sample)
    ov = p["overview"].first()
    assert (ov.rows, ov.columns, ov.duplicate_rows) == (5, 4, 0)
    miss = p["missing"].collect()
    assert [(r.column_name, r.missing_count, r.missing_percentage) for r in miss] == [("col_a", 1, 20.0)]
    cat = p["categorical"].first()
    assert (cat.top, cat.freq, cat.unique) == ("apple", 2, 3)  # tie apple/banana -> smallest
    sem = {r.column_name: r.semantic_type for r in p["semantic_types"].collect()}
    assert sem["col_a"] == "numeric_id_candidate" and sem["col_d"] == "datetime"


def test_skewness_is_bias_corrected(spark):
    import pandas as pd
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 4.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = profile.shape_moments(df).first()
    assert r.skewness == pytest.approx(pd.Series(vals).skew())
    assert r.kurtosis == pytest.approx(pd.Series(vals).kurt())


def test_reference_missing_value_suggestion(spark, sample):
    s = suggest.suggest_cleaning(sample).collect()
    miss = [r for r in s if r.issue == "Missing Values"]
    assert len(miss) == 1 and "col_a" in miss[0].details and "(20.0%)" in miss[0].details
    assert miss[0].params == {"column": "col_a", "strategy": "median"}


def test_relationships(spark):
    a = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    info = schema_info(spark, {"documents": a, "labels": b})
    rel = relations.find_relationships(info).collect()
    assert [(r.source1, r.column1, r.source2, r.column2) for r in rel] == [("documents", "doc_id", "labels", "doc_id")]
    c = relations.containment({"documents": a, "labels": b}, [("documents", "doc_id", "labels", "doc_id")]).first()
    assert c.containment == 1.0


def test_bad_custom_sql_is_an_error_row(spark, sample):
    rules = [{"rule_name": "bad", "rule_type": "custom_sql", "rule_parameters": {"condition": "nope > 1"}},
             {"rule_name": "ok", "rule_type": "custom_sql", "rule_parameters": {"condition": "col_c > 15"}}]
    r = _by_name(quality.run_quality_checks(sample, rules))
    assert r["bad"].status == "error" and r["ok"].violation_count == 2


def test_enum_lists_of_any_length_agree(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,), ("z",)], "c string")
    numbers = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (-5.0,)], "c double")
    for extra in (0, 10_001):
        rule = [{"rule_name": "e", "rule_type": "enum_values", "column_name": "c",
                 "rule_parameters": {"allowed": ["a", "b", *[f"v{i}" for i in range(extra)]]}}]
        r = quality.run_quality_checks(df, rule).first()
        assert (r.violation_count, r.sample_failures) == (2, ["z"])
        good, bad = quality.split(df, rule)
        assert good.count() == 3 and [x.failed_rules for x in bad.collect()] == [["e"], ["e"]]
        rule[0]["rule_parameters"]["allowed"] = [1.0, 2.0, *[float(i) for i in range(3, 3 + extra)]]
        assert quality.run_quality_checks(numbers, rule).first().violation_count == 1  # NaN is missing


def test_one_hot_vectors(spark):
    from vellum.operators import features
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "c string, k int")
    out = features.categorical_encoding(df, ["c"], method="one-hot-vector")
    assert out.columns == ["k", "c_vec"]
    rows = {r.k: r.c_vec.toArray().tolist() for r in out.collect()}
    assert rows[2] == [1.0, 0.0, 0.0] and rows[1] == [0.0, 1.0, 0.0] and rows[3] == [0.0, 0.0, 1.0]


def test_profile_sample_is_repeatable(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = profile.profile(df, sample_rows=100)["overview"].first()
    b = profile.profile(df, sample_rows=100)["overview"].first()
    assert a.rows == 100 and a == b


def test_reference_shaped_api(spark, sample):
    from vellum import api
    rep = api.generate_profile_report(sample, "sample")
    assert rep["overview"]["rows"] == 5 and rep["missing_percentage"] == {"col_a": 20.0}
    assert rep["numeric_variables"]["col_a"]["p50"] == 2.5
    sugg = api.suggest_cleaning_steps(sample)
    assert any("(20.0%)" in s["details"] for s in sugg)
    res = api.run_quality_checks(sample, [{"rule_type": "not_null", "column_name": "col_a"}])
    assert res[0]["status"] == "failed"
    assert api.calculate_kpi_value({"name": "n", "calculation_logic": "count"}, sample) == 5.0
    assert api.execute_pipeline(sample, []) is sample


def test_fused_profile_equals_separate_tables(spark):
    import math as m
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    fused = profile.profile(df)
    separate = {"overview": profile.overview(df), "numeric": profile.describe_numeric(df),
                "missing": profile.missing_values(df), "unique": profile.unique_counts(df),
                "moments": profile.shape_moments(df), "semantic_types": profile.semantic_types(df)}
    for name, sep in separate.items():
        a = sorted(map(tuple, fused[name].collect()), key=str)
        b = sorted(map(tuple, sep.collect()), key=str)
        assert len(a) == len(b), name
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                if isinstance(u, float) and isinstance(v, float):
                    assert m.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9), (name, x, y)
                else:
                    assert u == v, (name, x, y)
