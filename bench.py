"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run once to warm up, then timed ``$BENCH_RUNS`` times (default 3)
with its result written to the ``noop`` sink (the whole plan runs, nothing is
collected); the median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vellum.session import get_session  # noqa: E402
from vellum.suite import load_all  # noqa: E402

HEADLINE = [
    "pl1_steps",                   # impute (median), date parts, group transform
    "dq11_runner",                 # 8 rules on lineitem, one fused aggregation
    "ag10_describe",               # numeric describe of every lineitem column
    "cl1_drop_duplicates",
    "cl1_drop_duplicates_subset_first",
    "fe8_polynomial",
    "an1_zscore_lineitem",
    "ts7_trend_weekly_per_user",   # one series per user
    "sg3_kmeans_rows",
    "sql1_inner_join",
    "sql10_grouping_sets",
    "ch8_density_heatmap",
    "wn1_rolling_nan",             # rolling mean and change over all events, default buckets
    "jn10_containment",            # 8 column pairs, one grouping
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = get_session(master=f"local[{cpus}]", app="vellum-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "4g")})
    reg = load_all()
    timings = {}
    for name in names:
        q = reg[name]
        q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            q.run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 3)
    comparisons = {}
    if "dq11_runner" in names:
        # the reference's way: one pass over the table per rule
        from vellum.operators import quality
        from vellum.suite.quality import LI_RULES
        li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")

        def per_rule():
            for rule in LI_RULES:
                quality.run_quality_checks(li, [rule]).write.format("noop").mode("overwrite").save()
        per_rule()
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            per_rule()
            samples.append(time.perf_counter() - t0)
        comparisons["dq11_one_pass_per_rule"] = round(statistics.median(samples), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus), "runs": runs,
                      "comparisons": comparisons}))
    spark.stop()


if __name__ == "__main__":
    main()
