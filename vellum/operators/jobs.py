"""Jobs over every registered source: quality checks (JB1) and anomaly scans (JB2).

The loop runs over a bounded list of source names (one entry per table,
from the rules table); each iteration only adds to one lazy plan, and a
source that cannot be loaded is reported, not fatal.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import anomalies, quality

log = logging.getLogger(__name__)


@dataclass
class CheckRun:
    results: DataFrame      # one row per rule and source
    summary: DataFrame      # failed / error counts per source
    skipped: list           # sources that could not be loaded


def check_sources(spark: SparkSession, rules, load: Callable[[str], DataFrame]) -> CheckRun:
    """Run the active rules of every source; ``load(name)`` returns its table."""
    all_rules = quality.normalise_rules(rules)
    active = [r for r in all_rules if r.get("is_active", True)]
    sources = sorted({r.get("source") for r in active if r.get("source")})
    parts, skipped = [], []
    for s in sources:
        try:
            df = load(s)
            df.schema  # resolve now: a missing table is skipped, not fatal
        except Exception as e:  # noqa: BLE001
            log.error("Source '%s' cannot be read: %s", s, str(e).splitlines()[0])
            skipped.append(s)
            continue
        parts.append(quality.run_quality_checks(df, [r for r in active if r.get("source") == s], source=s))
    if not parts:
        empty = spark.createDataFrame([], quality.RESULT_SCHEMA)
        return CheckRun(empty, empty.groupBy("source").count(), skipped)
    results = parts[0]
    for p in parts[1:]:
        results = results.unionByName(p)
    summary = results.groupBy("source").agg(
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count(F.lit(1)).alias("rules_run"))
    return CheckRun(results, summary, skipped)


@dataclass
class AnomalyScan:
    findings: DataFrame     # source + the columns of a finding
    skipped: list           # sources that could not be loaded


def scan_anomalies(spark: SparkSession, sources: dict[str, dict], load: Callable[[str], DataFrame]) -> AnomalyScan:
    """Findings of every source: z-scores of its numeric columns and, where
    ``{"time_column": ..., "tie_breaker": [...]}`` names a time column, the
    trend check. All sources form one lazy plan."""
    parts, skipped = [], []
    for name in sorted(sources):
        try:
            df = load(name)
            df.schema
        except Exception as e:  # noqa: BLE001
            log.error("Source '%s' could not be loaded: %s", name, str(e).splitlines()[0])
            skipped.append(name)
            continue
        spec = sources[name] or {}
        found = anomalies.find_anomalies(df, spec.get("time_column"), spec.get("tie_breaker"))
        parts.append(found.select(F.lit(name).alias("source"), "*"))
    if not parts:
        return AnomalyScan(spark.createDataFrame([], anomalies.ANOMALY_SCHEMA).select(F.lit("").alias("source"), "*"), skipped)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return AnomalyScan(out, skipped)
