"""Entry points shaped like the reference's functions, for code written against it.

Each one runs the Spark operators and returns the small, bounded result the
reference returns (a dict per column, rule, suggestion or finding); the data
work stays in Spark and only those summaries reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators import anomalies, kpi, profile, quality, relations, suggest
from vellum.plans.steps import apply_step, run_steps
from vellum.sources.schema import schema_info


def _r2(v):
    return None if v is None else round(float(v), 2)


def generate_profile_report(df: DataFrame, source_name: str = "DataFrame", sample_rows: int | None = None) -> dict:
    p = profile.profile(df, sample_rows=sample_rows)
    ov = p["overview"].first()
    numeric = {r.column_name: {k: (r[k] if k == "count" else _r2(r[k]))
                               for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")}
               for r in p["numeric"].collect()}
    categorical = {r.column_name: {"count": r["count"], "unique": r["unique"], "top": r["top"], "freq": r["freq"]}
                   for r in p["categorical"].collect()}
    missing = p["missing"].collect()
    moments = p["moments"].collect()
    return {
        "overview": {"source_name": source_name, "rows": ov.rows, "columns": ov.columns,
                     "duplicates_in_profile": ov.duplicate_rows, "rows_profiled": ov.rows},
        "numeric_variables": numeric,
        "categorical_variables": categorical,
        "missing_values": {r.column_name: r.missing_count for r in missing},
        "missing_percentage": {r.column_name: _r2(r.missing_percentage) for r in missing},
        "additional_stats": {
            "unique_counts": {r.column_name: r.unique_count for r in p["unique"].collect()},
            "skewness": {r.column_name: _r2(r.skewness) for r in moments},
            "kurtosis": {r.column_name: _r2(r.kurtosis) for r in moments},
        },
    }


def _suggestions(df: DataFrame) -> list[dict]:
    return [{"step_type": r.step_type, "params": dict(r.params or {}), "issue": r.issue, "details": r.details,
             "rationale": r.rationale} for r in df.collect()]


def suggest_cleaning_steps(df: DataFrame) -> list[dict]:
    return _suggestions(suggest.suggest_cleaning(df))


def suggest_feature_engineering(df: DataFrame) -> list[dict]:
    return _suggestions(suggest.suggest_features(df))


def apply_cleaning_step(df: DataFrame, step_type: str, params: dict) -> DataFrame:
    return apply_step(df, step_type, params)


apply_feature_engineering = apply_cleaning_step


def execute_pipeline(initial_data, pipeline_steps, spark: SparkSession | None = None) -> DataFrame:
    return run_steps(initial_data, pipeline_steps, spark=spark)


def run_quality_checks(df: DataFrame, rules) -> list[dict]:
    return [r.asDict() for r in quality.run_quality_checks(df, rules).collect()]


def find_proactive_anomalies(current_df: DataFrame, previous_df: DataFrame | None = None,
                             time_column: str | None = None) -> list[dict]:
    found = anomalies.find_anomalies(current_df, time_column)
    return [{"type": r.type, "details": r.details, "severity": r.severity} for r in found.collect()]


def calculate_kpi_value(kpi_definition: dict, df: DataFrame) -> float | None:
    row = kpi.calculate_kpis(df, [kpi_definition]).first()
    return None if row is None else row.value


def find_relationships(spark: SparkSession, tables: dict[str, DataFrame]) -> list[dict]:
    return [r.asDict() for r in relations.find_relationships(schema_info(spark, tables)).collect()]
