"""Winners of parameter experiments and the state of a tuning plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import comparison

GROUP = comparison.GROUP
PLACEHOLDER_PREFIX = "<"


def group_winners(kept: DataFrame, metric: str) -> DataFrame:
    """Run with the largest metric per group, the newest on a tie, with its parameters."""
    value = F.col(metric).try_cast("double")
    picked = F.struct(
        F.col("run_id").alias("winner_run_id"),
        F.col("variant_name").alias("winner_variant_name"),
        value.alias("winner_metric_value"),
        F.col("params").alias("winner_params"),
    )
    order = F.struct((-value).alias("key"), comparison.newest_first().alias("order"))
    return (
        kept.filter(value.isNotNull())
        .groupBy(GROUP)
        .agg(F.min_by(picked, order).alias("w"))
        .select(GROUP, "w.*")
    )


def summarize_experiments(
    plan: DataFrame, groups: DataFrame, winners: DataFrame, metric: str, require_valid: bool = True
) -> DataFrame:
    """Plan rows with status, blocked reason and winner.

    plan: position, label, comparison_group_id, changed_parameter. The other inputs have one
    row per group, so a group named by several plan rows repeats no run.
    """
    info = groups.select(
        GROUP,
        "comparison_status",
        "run_count",
        F.col("raw_run_count").alias("_raw"),
        *comparison.CHECK_NAMES,
    )
    rows = plan.join(info, GROUP, "left").join(winners, GROUP, "left")
    name = F.trim(F.coalesce(GROUP, F.lit("")))
    placeholder = (name == "") | name.startswith(PLACEHOLDER_PREFIX)
    failed = F.array_join(
        F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in comparison.CHECK_NAMES])), ", "
    )
    invalid = F.lit(require_valid) & (F.col("comparison_status") != "valid")
    # Reasons in the order they are tried.
    reason = (
        F.when(placeholder, F.lit("comparison_group_id is a placeholder"))
        .when(F.col("_raw").isNull(), F.lit("no runs found for comparison_group_id"))
        .when(invalid, F.concat(F.lit("comparison contract invalid: "), failed))
        .when(F.col("winner_run_id").isNull(), F.lit(f"missing winner metric: {metric}"))
    )
    rows = rows.withColumn("blocked_reason", reason)
    blocked = F.col("blocked_reason").isNotNull()
    open_only = ("winner_run_id", "winner_variant_name", "winner_metric_value", "winner_params")
    return rows.withColumns(
        {
            "status": F.when(blocked, F.lit("blocked")).otherwise(F.lit("valid")),
            "comparison_status": F.coalesce(
                F.when(~placeholder, F.col("comparison_status")), F.lit("blocked")
            ),
            "raw_run_count": F.coalesce("_raw", F.lit(0)),
            **{c: F.when(~blocked, F.col(c)) for c in open_only},
        }
    ).drop("_raw", *comparison.CHECK_NAMES)


def combined_draft(experiments: DataFrame) -> DataFrame:
    """Parameters of the combined draft: per changed parameter the last valid winner."""
    picked = F.struct("winner_run_id", "winner_params")
    return (
        experiments.filter("status = 'valid'")
        .groupBy("changed_parameter")
        .agg(F.max_by(picked, "position").alias("p"), F.count("*").alias("winner_count"))
        .select("changed_parameter", "p.*", "winner_count")
    )


def blocked_experiments(experiments: DataFrame) -> DataFrame:
    """position, label of every experiment that blocks the plan, one row each."""
    return experiments.filter("status = 'blocked'").select("position", "label")


def final_validation(experiments: DataFrame, changed_variable: str = "candidate_config", baseline_required: bool = True) -> DataFrame:
    """Settings of the final validation as (setting, value) rows; none while an experiment is blocked."""
    settings = {"recommended_changed_variable": changed_variable, "baseline_required": str(baseline_required).lower()}
    rows = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(v).alias("value")) for k, v in settings.items()])
    return experiments.agg(F.count_if(F.col("status") == "blocked").alias("_n")).filter("_n = 0").select(F.inline(rows))


def plan_status(experiments: DataFrame, next_experiment: str = "final_candidate_tournament") -> DataFrame:
    """One row: overall status and the recommended next step."""
    blocked, valid = F.col("blocked_count"), F.col("winner_count")
    # Statuses and steps.
    return experiments.agg(
        F.count("*").alias("experiment_count"),
        F.count_if(F.col("status") == "valid").alias("winner_count"),
        F.count_if(F.col("status") == "blocked").alias("blocked_count"),
        F.min_by("label", F.when(F.col("status") == "blocked", F.col("position"))).alias(
            "first_blocked_label"
        ),
    ).withColumns(
        {
            "status": F.when(blocked > 0, F.lit("blocked"))
            .when(valid > 0, F.lit("requires_final_validation"))
            .otherwise(F.lit("no_valid_experiments")),
            "next_step": F.when(blocked > 0, F.lit("fix_blocked_parameter_experiments")).otherwise(
                F.lit("run_final_candidate_tournament")
            ),
            "recommended_experiment_name": F.lit(next_experiment),
        }
    )
