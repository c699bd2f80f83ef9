import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import anomalies, charts, kpi, ordered, segments, timeseries


def test_global_index_and_halo_rolling(spark):
    rows = [(i, float((i * 37) % 11) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, v double").repartition(5)
    idx = ordered.with_global_index(df, ["i"], partitions=4)
    assert sorted((r.i, r.idx) for r in idx.collect()) == [(i, i) for i in range(200)]
    got = ordered.rolling(df, "v", ["i"], 5, bucket_rows=13).orderBy("i").collect()
    w = Window.orderBy("i")
    wr = w.rowsBetween(-4, 0)
    ref = (df.withColumn("rm", F.when(F.count("v").over(wr) == 5, F.avg("v").over(wr)))
           .withColumn("d", F.col("rm") - F.lag("rm").over(w)).orderBy("i").collect())
    for a, b in zip(got, ref):
        assert a.v_rolling_mean == pytest.approx(b.rm) if b.rm is not None else a.v_rolling_mean is None
        assert (a.v_rolling_mean_diff is None) == (b.d is None)


def test_kpis(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (2, None)], "k int, v double")
    out = {r.name: r.value for r in kpi.calculate_kpis(df, [
        {"name": "n", "calculation_logic": "count"}, {"name": "u", "calculation_logic": "count_unique 'k'"},
        {"name": "s", "calculation_logic": "sum 'v'"}, {"name": "m", "calculation_logic": "median 'v'"},
        {"name": "e", "calculation_logic": "max(v) - min(v)"}, {"name": "bad", "calculation_logic": "sum 'zz'"}]).collect()}
    assert out == {"n": 3.0, "u": 2.0, "s": 6.0, "m": 3.0, "e": 2.0, "bad": None}


def test_kpi_formatting_and_status(spark):
    df = spark.createDataFrame([(1234.5,), (None,), (0.125,)], "v double")
    neg = spark.createDataFrame([(-5.0,)], "v double").select(kpi.format_value(F.col("v"), "currency")).first()[0]
    assert neg == f"${-5.0:,.2f}"
    got = [tuple(r) for r in df.select(kpi.format_value(F.col("v"), "currency"), kpi.format_value(F.col("v"), "percentage"),
                                       kpi.threshold_status(F.col("v"), 1000.0, 1.0)).collect()]
    assert got[0] == (f"${1234.5:,.2f}", f"{1234.5:.2%}", "above_upper")
    assert got[1] == ("N/A", "N/A", None)
    assert got[2][0] == f"${0.125:,.2f}" and got[2][2] == "below_lower"


def test_track_trend(spark):
    hist = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 5.0), ("a", dt.datetime(2024, 1, 2), 7.0)],
                                 "name string, run_ts timestamp, value double")
    cur = spark.createDataFrame([("a", 6.0), ("b", 1.0)], "name string, value double")
    out = {r.name: (r.delta, r.trend) for r in kpi.track(cur, hist).collect()}
    assert out == {"a": (-1.0, -1), "b": (None, None)}


def test_zscore_findings(spark):
    rows = [(float(v),) for v in [10] * 30 + [1000]]
    out = anomalies.zscore_anomalies(spark.createDataFrame(rows, "x double")).collect()
    assert len(out) == 1 and out[0].outlier_count == 1 and "Max value: 1000.0" in out[0].details


def test_forecast_errors_and_freq(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), float(d)) for d in range(1, 11)], "ds date, y double")
    with pytest.raises(ValueError):
        timeseries.generate_forecast(df, "ds", "y", 3, model_name="magic")
    assert timeseries.infer_freq(df).first().freq == "D"
    assert timeseries.infer_freq(df.limit(2)).first().freq is None
    fc = timeseries.trend_weekly(df, 3).filter("y IS NULL").orderBy("ds").collect()
    assert [r.ds for r in fc] == [dt.date(2024, 1, 11), dt.date(2024, 1, 12), dt.date(2024, 1, 13)]
    assert fc[0].trend == pytest.approx(11.0)


def test_chart_checks(spark, sample):
    with pytest.raises(ValueError):
        charts.chart_data(sample, "bar", x="col_b")
    with pytest.raises(ValueError):
        charts.chart_data(sample, "treemap")
    with pytest.raises(ValueError):
        charts.chart_data(sample, "pie", x="col_b", y="nope")
    tree = charts.chart_data(sample, "sunburst", path=["col_b"], values="col_c").collect()
    assert {r.col_b: r.value for r in tree}["apple"] == pytest.approx(20.2)


def test_segments_invariants(spark):
    rows = [(float(i % 3) * 10 + (i % 5) * 0.1, float(i % 3)) for i in range(60)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    seg = segments.find_segments(df, ["a", "b"], 3, with_silhouette=True)
    out = seg.rows.collect()
    assert sum(1 for r in out if r.segment is None) == 1
    assert sum(r.size for r in seg.summary.collect()) == 60
    assert all(0 <= v <= 1 for v in seg.explained_variance) and sum(seg.explained_variance) <= 1 + 1e-9
    assert seg.silhouette > 0.5
    with pytest.raises(ValueError):
        segments.find_segments(df, ["a"], 1)


def test_grouped_exact_quantiles_hot_and_normal_groups(spark):
    import numpy as np
    from vellum.operators.quantiles import grouped_exact_quantiles
    rows = [("hot", float((i * 7919) % 1000)) for i in range(3000)] + [("a", float(i)) for i in range(10)] + \
           [(None, 5.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: (r.q0, r.q1) for r in grouped_exact_quantiles(df, "g", "v", [0.5, 0.9]).collect()}
    for key in ("hot", "a", None):
        vals = [v for g, v in rows if g == key]
        assert out[key][0] == np.median(vals)
        assert out[key][1] == np.percentile(vals, 90)


def test_quantiles_with_infinities_and_wide_ranges(spark):
    import numpy as np
    from vellum.operators.quantiles import exact_quantiles, grouped_exact_quantiles
    rng = np.random.default_rng(4)
    columns = {"inf": [*rng.normal(size=5000), float("inf")], "both": [*range(3000), *[float("inf"), float("-inf")] * 800],
               "wide": [*(10.0 ** rng.uniform(-300, 300, 3000)), -1.7e308, 1.7e308], "only": [float("inf")] * 5}
    for name, vals in columns.items():
        df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "v double")
        ranks = np.sort(np.array(vals, float))
        got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.75, 1.0])["v"]
        odd = len(vals) % 4 == 1  # the quartiles are values themselves
        if odd:
            assert got == [ranks[0], ranks[(len(ranks) - 1) // 4], ranks[3 * (len(ranks) - 1) // 4], ranks[-1]]
        assert got[0] == ranks[0] and got[-1] == ranks[-1]
        row = grouped_exact_quantiles(df.selectExpr("1 AS g", "v"), "g", "v", [0.0, 1.0]).first()
        assert (row.q0, row.q1) == (ranks[0], ranks[-1])


def test_trend_change_fires_on_a_jump(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 3)) for i in range(40)]
    rows.append((dt.datetime(2024, 1, 3), 500.0))  # newest point jumps
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = anomalies.trend_change(df, "ts", bucket_rows=7).collect()
    assert len(out) == 1 and "increase" in out[0].details and out[0].column_name == "v"


def test_per_key_rolling_index_equals_window(spark):
    rows = [(k, i, float((i * 13 + k) % 7)) for k in range(4) for i in range(30 if k else 120)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    a = ordered.rolling(df, "v", ["i"], 5, partition_by=["k"], bucket_rows=11).orderBy("k", "i").collect()
    b = ordered.rolling(df, "v", ["i"], 5, partition_by=["k"], strategy="window").orderBy("k", "i").collect()
    for x, y in zip(a, b):
        assert (x.v_rolling_mean is None) == (y.v_rolling_mean is None)
        assert (x.v_rolling_mean_diff is None) == (y.v_rolling_mean_diff is None)
        if y.v_rolling_mean_diff is not None:
            assert x.v_rolling_mean_diff == pytest.approx(y.v_rolling_mean_diff)


def test_generate_forecast_infers_frequency(spark):
    df = spark.createDataFrame([(dt.datetime(2024, m, 1), float(m)) for m in range(1, 13)], "ts timestamp_ntz, v double")
    out = timeseries.generate_forecast(df, "ts", "v", periods=2, model_name="simple")
    assert [r.ds for r in out.orderBy("ds").collect()] == [dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)]
    with pytest.raises(ValueError):
        timeseries.generate_forecast(df.limit(2), "ts", "v", periods=2, model_name="simple")


def test_quarter_and_year_grids(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 2, 10), 1.0), (dt.datetime(2024, 11, 3), 2.0)], "ds timestamp_ntz, y double")
    qe = [r.ds for r in timeseries.asfreq(df, "Q").orderBy("ds").collect()]
    assert qe[0] == dt.datetime(2023, 3, 31) and qe[-1] == dt.datetime(2024, 9, 30) and len(qe) == 7
    ys = [r.ds for r in timeseries.asfreq(df, "YS").collect()]
    assert ys == [dt.datetime(2024, 1, 1)]
    fut = [r.ds for r in timeseries.future(df, 2, "QS").orderBy("ds").collect()]
    assert fut == [dt.datetime(2025, 1, 1), dt.datetime(2025, 4, 1)]
    ends = [r.ds for r in timeseries.future(df, 2, "Q").orderBy("ds").collect()]
    assert ends == [dt.datetime(2024, 12, 31), dt.datetime(2025, 3, 31)]


def test_target_achieved(spark):
    df = spark.createDataFrame([(5.0,), (4.0,)], "v double")
    assert [r[0] for r in df.select(kpi.target_achieved(F.col("v"), 5.0)).collect()] == [True, False]


def test_infer_quarter_and_year(spark):
    q = spark.createDataFrame([(dt.datetime(2023, m, 1), 1.0) for m in (1, 4, 7, 10)], "ds timestamp_ntz, y double")
    assert timeseries.infer_freq(q).first().freq == "QS"
    y = spark.createDataFrame([(dt.datetime(yr, 12, 31), 1.0) for yr in (2020, 2021, 2022)], "ds timestamp_ntz, y double")
    assert timeseries.infer_freq(y).first().freq == "Y"


def test_segments_against_bruteforce(spark):
    import numpy as np
    cust = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    feats = ["c_acctbal", "c_nationkey"]
    seg = segments.find_segments(cust, feats, 3)
    rows = seg.rows.select(*feats, "segment").collect()
    x = np.array([[r.c_acctbal, r.c_nationkey] for r in rows], dtype=float)
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / std
    summary = {r.segment: r for r in seg.summary.collect()}
    centres = np.array([[(summary[k][f"center_{f}"] - mean[j]) / std[j] for j, f in enumerate(feats)]
                        for k in sorted(summary)])
    nearest = np.argmin(((z[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), axis=1)
    assert (nearest == np.array([r.segment for r in rows])).mean() > 0.99
    ratios = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    ratios = ratios / ratios.sum()
    assert seg.explained_variance == pytest.approx(list(ratios[:2]), rel=1e-6)


def test_null_keys_are_series(spark):
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(i), float(i % 7 + (k is None) * i)) for k in ("a", None) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    for model in ("prophet", "arima", "sarima", "simple"):
        out = timeseries.generate_forecast(df, "ds", "y", 5, "D", model, ["k"]).collect()
        assert {r.k for r in out} == {"a", None}
        ahead = [r for r in out if r.ds > dt.date(2024, 1, 30)]
        assert len(ahead) == 10 and all((r.yhat if model == "prophet" else r.forecast) is not None for r in ahead)
    assert timeseries.resample(df, "D", "sum", ["k"]).filter("k IS NULL AND y IS NOT NULL").count() == 30


def test_a_line_goes_on(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), 2.0 * i) for i in range(30)], "ds date, y double")
    out = timeseries.ar_diff(df, 5).filter("forecast IS NOT NULL").orderBy("ds").collect()
    assert [r.forecast for r in out] == pytest.approx([60.0, 62.0, 64.0, 66.0, 68.0])
    assert [r.upper - r.lower for r in out] == pytest.approx([0.0] * 5)


def test_grid_of_seconds_over_years_comes_in_blocks(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 8), 2.0)], "ds timestamp_ntz, y double")
    out = timeseries.asfreq(df, "s")
    assert out.count() == 7 * 86400 + 1 and out.filter("y IS NOT NULL").count() == 2
    assert out.agg(F.max("ds")).first()[0] == dt.datetime(2024, 1, 8) and out.select("ds").distinct().count() == 7 * 86400 + 1


def test_quantiles_read_in_cells_equal_numpy(spark, monkeypatch):
    import numpy as np

    from vellum.operators import quantiles
    rng = np.random.default_rng(3)
    cols = {"flat": rng.uniform(-5, 5, 20_000), "few": rng.integers(0, 4, 20_000).astype(float),
            "wide": 10.0 ** rng.uniform(-300, 300, 20_000), "same": np.full(20_000, 7.0)}
    rows = [tuple(map(float, r)) for r in np.stack(list(cols.values()), 1)] + [(None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    for fetch in (quantiles.FETCH, 0):
        monkeypatch.setattr(quantiles, "FETCH", fetch)
        got = quantiles.exact_quantiles(df, list(cols), qs, median_mean=False)
        for c, v in cols.items():
            assert got[c] == np.quantile(v, qs).tolist()


def test_quantiles_survive_a_bad_sketch(spark, monkeypatch):
    """Brackets that miss their ranks are opened, the result stays exact."""
    import numpy as np

    from vellum.operators import quantiles
    df = spark.range(10_000).selectExpr("CAST(id AS DOUBLE) AS v")
    real = quantiles._brackets

    def wrong(*args):
        out = real(*args)
        for b in out[0]:
            b.lo, b.hi = 9_000.0, 9_100.0
        return out
    monkeypatch.setattr(quantiles, "_brackets", wrong)
    assert quantiles.exact_quantiles(df, ["v"], [0.25, 0.5])["v"] == np.quantile(np.arange(10_000), [0.25, 0.5]).tolist()


def test_rows_without_a_time_come_last(spark):
    rows = [(dt.datetime(2024, 1, 1 + i), 10.0 + i % 2) for i in range(20)] + [(None, 500.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double").repartition(4)
    found = anomalies.trend_change(df, "ts").collect()
    assert len(found) == 1 and "increase" in found[0].details


def test_arma_finds_its_coefficients(spark):
    """Simulated ARMA(1,1) differences: two regressions come near the truth, and short series get a forecast."""
    import random
    rng = random.Random(12)
    y, d, e, rows = 0.0, 0.0, 0.0, []
    for i in range(3000):
        u = rng.gauss(0, 1)
        d, e = 0.1 + 0.6 * d + 0.3 * e + u, u
        y += d
        rows.append(("long", dt.date(2000, 1, 1) + dt.timedelta(i), y))
    rows += [("short", dt.date(2024, 1, 1) + dt.timedelta(i), v) for i, v in enumerate([1.0, 2.0, 4.0, 5.0])]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    out = timeseries.arma_diff(df, 3, keys=["k"]).filter("history IS NULL").orderBy("k", "ds").collect()
    long = [r.forecast for r in out if r.k == "long"]
    first = long[0] - y
    assert abs(first - (0.1 + 0.6 * d + 0.3 * e)) < 0.25  # one step ahead
    assert abs((long[1] - long[0]) - (0.1 + 0.6 * first)) < 0.15
    assert all(r.forecast is not None for r in out if r.k == "short")
