"""Count Spark jobs and stages a registered query runs (noop sink).

usage: python scripts/count_jobs.py sf_dir name [name ...]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vellum.session import get_session  # noqa: E402
from vellum.suite import load_all  # noqa: E402


def main():
    sf, names = sys.argv[1], sys.argv[2:]
    spark = get_session()
    sc = spark.sparkContext
    reg = load_all()
    for name in names:
        reg[name].run(spark, sf).write.format("noop").mode("overwrite").save()  # warm
        group = f"g-{name}-{time.time()}"
        sc.setJobGroup(group, name)
        t0 = time.perf_counter()
        reg[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t0
        jobs = sc.statusTracker().getJobIdsForGroup(group)
        stages = sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs)
        print(f"{name:40s} jobs={len(jobs):3d} stages={stages:3d} {dt:.2f}s")


if __name__ == "__main__":
    main()
