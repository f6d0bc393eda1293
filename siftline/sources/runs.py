"""Experiment runs: normalising stored values, tag filters, event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags and metrics every normalised run has a column for.
RUN_TAGS = (
    "variant_name",
    "variant_type",
    "comparison_type",
    "changed_variable",
    "comparison_group_id",
    "experiment_name",
    "experiment_config_path",
    "experiment_config_sha256",
    "split_sha256",
    "train_split_sha256",
    "test_split_sha256",
    "feature_pipeline_name",
    "feature_pipeline_sha256",
    "vectorizer_name",
    "model_family",
    "policy_sha256",
    "training_data_sha256",
    "evaluation_code_sha256",
)
RUN_METRICS = (
    "combined_accuracy",
    "f1_macro",
    "combined_f1_macro",
    "combined_weakest_class_recall",
    "low_confidence_count",
    "low_confidence_rate",
    "approval_required_count",
    "approval_required_rate",
    "policy_block_count",
    "llm_fallback_count",
    "invalid_decision_schema_count",
    "offline_decision_latency_p50_ms",
    "offline_decision_latency_p95_ms",
    "offline_decision_latency_max_ms",
)


def normalize_runs(values: DataFrame) -> DataFrame:
    """One row per run from long (run_id, kind, key, value) rows.

    An absent, NaN or null tag reads 'unknown', an absent metric is null; the group falls
    back to its older tag name. The pivot has a fixed key list, so it is one aggregate with
    no extra job; other parameters stay in a map whose size is one run's own parameters.
    """
    value = F.when(F.col("value").isNotNull() & ~F.col("value").isin("NaN", "nan"), F.col("value"))
    rows = values.withColumn("value", value)

    def cell(kind: str, key: str):
        return f"max(value) FILTER (WHERE kind = '{kind}' AND key = '{key}')"

    def text(kind: str, *keys: str, default: str = "unknown"):
        return F.expr(f"coalesce({', '.join(cell(kind, k) for k in keys)}, '{default}')")

    tags = {t: text("tags", t) for t in RUN_TAGS}
    tags["comparison_group_id"] = text("tags", "comparison_group_id", "fair_comparison_group_id")
    tags["controlled_variables"] = text("tags", "controlled_variables", default="")
    metrics = {m: F.expr(f"try_cast({cell('metrics', m)} AS DOUBLE)") for m in RUN_METRICS}
    info = {
        "run_name": text("info", "run_name"),
        "status": text("info", "status"),
        "start_time": text("info", "start_time", default=""),
    }
    is_param = (F.col("kind") == "params") & F.col("value").isNotNull()
    params = F.map_from_entries(F.collect_set(F.when(is_param, F.struct("key", "value"))))
    columns = info | tags | metrics
    return rows.groupBy("run_id").agg(
        *[c.alias(name) for name, c in columns.items()], params.alias("params")
    )


def filter_by_tag(runs: DataFrame, tag: str, value: str) -> DataFrame:
    """Runs with one tag value; on a column store the scan applies the filter."""
    return runs.filter(F.col(tag) == F.lit(value))


def selection_events(report: DataFrame, generated_at: str, policy_name: str, policy_version: str) -> DataFrame:
    """Event rows for the groups in which a candidate was selected."""
    return report.filter(F.col("selection_status") == "selected").select(
        F.lit("candidate_selected").alias("event_type"),
        F.lit(generated_at).alias("generated_at"),
        F.col("comparison_group_id").alias("scope"),
        "selected_run_id",
        "baseline_run_id",
        F.lit(policy_name).alias("policy_name"),
        F.lit(policy_version).alias("policy_version"),
    )


def append_events(events: DataFrame, path: str) -> None:
    """Append to the event log."""
    events.write.mode("append").json(path)
