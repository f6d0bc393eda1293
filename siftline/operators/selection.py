"""Candidate gating, selection and lifecycle, for all comparison groups at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.once import computed_once
from siftline.operators import comparison, lookup

GROUP = comparison.GROUP

# Reasons that show up in results.
ALL_PASSED = "all_threshold_checks_passed"
ENOUGH_GAIN = "sufficient_improvement_over_baseline"
TOO_LITTLE_GAIN = "insufficient_improvement_over_baseline"
NO_BASELINE_F1 = "missing_f1_macro_for_baseline_comparison: "
IS_BASELINE = "candidate_is_baseline_run"
EVIDENCE_FAILED = "promotion_evidence_contract_failed"
ELIGIBLE = "candidate_policy_and_baseline_passed"
NOT_BEST = "eligible_but_not_selected_better_candidate_exists"
BASELINE_UNCHANGED = "baseline_run_status_not_changed"


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _check_status(rule: cfg.MetricThreshold) -> Column:
    value = _number(rule.metric)
    meets = value >= rule.threshold if rule.at_least else value <= rule.threshold
    return (
        F.when(value.isNull(), F.lit("missing"))
        .when(~F.isnan(value) & meets, F.lit("passed"))
        .otherwise(F.lit("failed"))
    )


def threshold_checks(runs: DataFrame, policy: cfg.SelectionPolicy) -> DataFrame:
    """Long rows: run, metric, direction, threshold, value and status of each check."""
    rows = F.array(
        *[
            F.struct(
                F.lit(rule.metric).alias("metric_name"),
                F.lit("gte" if rule.at_least else "lte").alias("comparison"),
                F.lit(rule.threshold).alias("threshold"),
                _number(rule.metric).alias("value"),
                _check_status(rule).alias("status"),
            )
            for rule in policy.thresholds
        ]
    )
    return runs.select("run_id", F.inline(rows))


def with_verdict(runs: DataFrame, policy: cfg.SelectionPolicy) -> DataFrame:
    """Add `policy_decision` and `policy_reason`: a missing metric asks for review, else a
    failed check rejects, else the run is ready. Checks stay inside the row."""

    def names(status: str) -> Column:
        hits = [
            F.when(_check_status(rule) == status, F.lit(rule.metric))
            for rule in sorted(policy.thresholds, key=lambda r: r.metric)
        ]
        return F.array_join(F.array_compact(F.array(*hits)), ", ")

    listed = computed_once(runs, {"_missing": names("missing"), "_failed": names("failed")})
    missing, failed = F.col("_missing"), F.col("_failed")
    return listed.withColumns(
        {
            "policy_decision": F.when(missing != "", policy.review)
            .when(failed != "", policy.rejected)
            .otherwise(policy.ready),
            "policy_reason": F.when(
                missing != "", F.concat(F.lit("missing_required_metrics: "), missing)
            )
            .when(failed != "", F.concat(F.lit("failed_threshold_checks: "), failed))
            .otherwise(F.lit(ALL_PASSED)),
        }
    ).drop("_missing", "_failed")


def with_baseline(runs: DataFrame, baselines: DataFrame, all_runs: DataFrame) -> DataFrame:
    """Attach `baseline_run_id` and `baseline_f1` of the run's group.

    baselines: one row per group with baseline_run_id, allow_override, override_reason.
    """
    counts = runs.groupBy(GROUP).agg(F.count("*").alias("_runs"))
    f1 = all_runs.select(F.col("run_id").alias("baseline_run_id"), _number("f1_macro").alias("baseline_f1"))
    dim = (
        baselines.select(GROUP, "baseline_run_id")
        .join(f1, "baseline_run_id", "left")
        .join(counts, GROUP)
    )
    return lookup.attach(runs, dim, GROUP, "_runs", spread="run_id")


def compare_to_baseline(runs: DataFrame, policy: cfg.SelectionPolicy) -> DataFrame:
    """Add decision, reason and the improvement over the attached baseline."""
    own, base = _number("f1_macro"), F.col("baseline_f1")
    absent = F.array_join(
        F.array_compact(
            F.array(
                F.when(own.isNull(), F.lit("candidate.f1_macro")),
                F.when(base.isNull(), F.lit("baseline.f1_macro")),
            )
        ),
        ", ",
    )
    unknown = own.isNull() | base.isNull()
    enough = ~F.isnan(own) & (own >= base + policy.minimum_f1_gain)
    return runs.withColumns(
        {
            "baseline_decision": F.when(unknown, policy.review)
            .when(enough, policy.ready)
            .otherwise(policy.rejected),
            "baseline_reason": F.when(unknown, F.concat(F.lit(NO_BASELINE_F1), absent))
            .when(enough, F.lit(ENOUGH_GAIN))
            .otherwise(F.lit(TOO_LITTLE_GAIN)),
            "actual_improvement": own - base,
            "minimum_required_f1": base + policy.minimum_f1_gain,
        }
    )


def _absent_keys(required: tuple[str, ...], values: str) -> Column:
    """Required keys that a map does not hold, or holds as null or an empty text."""
    filled = F.map_filter(
        values, lambda _, v: v.isNotNull() & (v.cast("string") != "")
    )
    wanted = F.array(*[F.lit(k) for k in required])
    return F.coalesce(F.array_except(wanted, F.map_keys(filled)), wanted)


def check_evidence(
    runs: DataFrame, artifacts: DataFrame, contract: cfg.EvidenceContract
) -> DataFrame:
    """run_id with missing params, metrics, tags and artifacts, and `evidence_status`.

    runs: run_id and the maps params, metrics, tags. artifacts: run_id, path. Paths are
    reduced to one flag per required name before they are joined, whatever their number.
    """
    base = F.element_at(F.split("path", "/"), -1)
    present = {
        f"_has_{k}": F.max((F.col("path") == name) | (base == name))
        for k, name in enumerate(contract.artifacts)
    }
    held = artifacts.groupBy("run_id").agg(*[c.alias(k) for k, c in present.items()])
    missing = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(f"_has_{k}", F.lit(False)), F.lit(name))
                for k, name in enumerate(contract.artifacts)
            ]
        )
    )
    lists = runs.select(
        "run_id",
        _absent_keys(contract.params, "params").alias("missing_params"),
        _absent_keys(contract.metrics, "metrics").alias("missing_metrics"),
        _absent_keys(contract.tags, "tags").alias("missing_tags"),
    )
    joined = lists.join(held, "run_id", "left").withColumn("missing_artifacts", missing)
    total = reduce(
        lambda a, b: a + b,
        [F.size(f"missing_{kind}") for kind in ("params", "metrics", "tags", "artifacts")],
    )
    return computed_once(
        joined.drop(*present),
        {"evidence_status": F.when(total == 0, F.lit("passed")).otherwise(F.lit("failed"))},
    )


def evaluate_candidates(
    kept: DataFrame,
    evidence: DataFrame,
    baselines: DataFrame,
    all_runs: DataFrame,
    policy: cfg.SelectionPolicy,
) -> DataFrame:
    """Verdict, baseline comparison, evidence and eligibility of every compared run."""
    rows = with_baseline(kept, baselines, all_runs)
    rows = compare_to_baseline(with_verdict(rows, policy), policy)
    rows = rows.join(evidence.select("run_id", "evidence_status"), "run_id", "left")
    is_baseline = F.col("run_id") == F.col("baseline_run_id")
    policy_ok = F.col("policy_decision") == policy.ready
    baseline_ok = F.col("baseline_decision") == policy.ready
    evidence_ok = F.coalesce(F.col("evidence_status") == "passed", F.lit(False))
    eligible = ~F.coalesce(is_baseline, F.lit(False)) & policy_ok & baseline_ok & evidence_ok
    reasons = F.concat_ws(
        "; ",
        F.when(~policy_ok, F.col("policy_reason")),
        F.when(~baseline_ok, F.col("baseline_reason")),
        F.when(~evidence_ok, F.lit(EVIDENCE_FAILED)),
    )
    return computed_once(rows, {"eligible": eligible}).withColumns(
        {
            "decision": F.when(F.col("eligible"), policy.ready).otherwise(policy.rejected),
            "evaluation_reason": F.when(is_baseline, F.lit(IS_BASELINE))
            .when(F.col("eligible"), F.lit(ELIGIBLE))
            .otherwise(reasons),
        }
    )


def selection_order() -> Column:
    """Ascending key: f1 down, then p95, low confidence, approval, start and id up."""

    def or_last(name: str) -> Column:
        return F.coalesce(_number(name), F.lit(float("inf")))

    return F.struct(
        F.coalesce(-_number("f1_macro"), F.lit(float("inf"))).alias("f1"),
        or_last("offline_decision_latency_p95_ms").alias("latency"),
        or_last("low_confidence_rate").alias("low"),
        or_last("approval_required_rate").alias("approval"),
        F.coalesce("start_time", F.lit("")).alias("start_time"),
        F.col("run_id").alias("run_id"),
    )


def select_candidates(evaluations: DataFrame) -> DataFrame:
    """Best eligible run per group; a mergeable minimum, not a sort of the group."""
    picked = F.struct(
        F.col("run_id").alias("selected_run_id"),
        F.col("variant_name").alias("selected_variant_name"),
        F.col("evaluation_reason").alias("selected_reason"),
    )
    return (
        evaluations.filter("eligible")
        .groupBy(GROUP)
        .agg(F.min_by(picked, selection_order()).alias("p"))
        .select(GROUP, "p.*")
    )


def current_candidates(runs: DataFrame) -> DataFrame:
    """Per group: number of current candidates and, if there is one, its id."""
    current = F.col("current_candidate") == "true"
    return runs.groupBy(GROUP).agg(
        F.count_if(current).alias("current_count"),
        F.min(F.when(current, F.col("run_id"))).alias("current_run_id"),
    )


def baseline_guard(baselines: DataFrame, current: DataFrame) -> DataFrame:
    """Guard status, mode and reason per group."""
    n = F.coalesce("current_count", F.lit(0))
    override = F.coalesce("allow_override", F.lit(False)) & (
        F.coalesce("override_reason", F.lit("")) != ""
    )
    # Status, mode, reason of each outcome.
    ladder = [
        (n == 0, "passed", "bootstrap_no_current_candidate", "no_current_candidate_exists"),
        (n > 1, "failed", "ambiguous_current_candidate", "multiple_current_candidates_found"),
        (
            F.col("baseline_run_id") == F.col("current_run_id"),
            "passed",
            "baseline_matches_current_candidate",
            "baseline_run_id_matches_current_candidate",
        ),
        (
            override,
            "passed_with_override",
            "non_current_baseline_override",
            "non_current_baseline_allowed_with_explicit_reason",
        ),
        (
            F.lit(True),
            "failed",
            "baseline_mismatch",
            "baseline_run_id_does_not_match_current_candidate",
        ),
    ]
    columns = {}
    for k, name in enumerate(("guard_status", "guard_mode", "guard_reason"), start=1):
        value = None
        for rung in ladder:
            value = (
                F.when(rung[0], F.lit(rung[k])) if value is None else value.when(rung[0], F.lit(rung[k]))
            )
        columns[name] = value
    joined = baselines.join(current, GROUP, "left").withColumn("current_count", n)
    return computed_once(joined, columns)


def selection_report(groups: DataFrame, guard: DataFrame, selected: DataFrame) -> DataFrame:
    """Per group: selection status and, when the contract and the guard allow it, the winner.

    All three inputs have one row per group.
    """
    rows = groups.select(GROUP, "comparison_status", "run_count", "raw_run_count")
    rows = rows.join(guard, GROUP).join(selected, GROUP, "left")
    guard_ok = F.col("guard_status").isin("passed", "passed_with_override")
    open_ = guard_ok & (F.col("comparison_status") == "valid")
    winner = {
        name: F.when(open_, F.col(name))
        for name in ("selected_run_id", "selected_variant_name", "selected_reason")
    }
    return computed_once(rows, winner).withColumn(
        "selection_status",
        F.when(~guard_ok, F.lit("blocked_by_baseline_guard"))
        .when(F.col("selected_run_id").isNotNull(), F.lit("selected"))
        .otherwise(F.lit("no_candidate_selected")),
    )


def status_transitions(evaluations: DataFrame, report: DataFrame) -> DataFrame:
    """What happens to the status of every evaluated run."""
    winner = report.select(GROUP, "selected_run_id", "raw_run_count")
    rows = lookup.attach(
        evaluations.drop("raw_run_count"), winner, GROUP, "raw_run_count", spread="run_id"
    )
    selected = F.coalesce(F.col("run_id") == F.col("selected_run_id"), F.lit(False))
    skip = F.coalesce(F.col("run_id") == F.col("baseline_run_id"), F.lit(False)) & ~selected
    flag = F.when(~skip, selected.cast("string"))
    return rows.withColumns(
        {
            "action": F.when(skip, F.lit("skip")).otherwise(F.lit("update")),
            "new_candidate_status": F.when(skip, F.lit(None).cast("string"))
            .when(selected, F.lit("selected"))
            .when(F.col("eligible"), F.lit("eligible"))
            .otherwise(F.lit("rejected")),
            "promotion_reason": F.when(skip, F.lit(BASELINE_UNCHANGED))
            .when(selected, F.col("evaluation_reason"))
            .when(F.col("eligible"), F.lit(NOT_BEST))
            .otherwise(F.col("evaluation_reason")),
            "candidate": flag,
            "current_candidate": flag,
        }
    )


def lifecycle(report: DataFrame) -> DataFrame:
    """Per group: new current run, how many are superseded, whether nothing changes."""
    chosen = F.col("selected_run_id")
    keeps = F.coalesce((F.col("current_count") == 1) & (F.col("current_run_id") == chosen), F.lit(False))
    return report.select(
        GROUP,
        chosen.alias("new_current_candidate_run_id"),
        F.col("current_count").alias("previous_current_count"),
        keeps.alias("already_current"),
    )


def superseded_runs(runs: DataFrame, report: DataFrame) -> DataFrame:
    """Current candidates that a newly selected run of their group replaces, one row each."""
    winners = report.filter(F.col("selected_run_id").isNotNull()).select(
        GROUP, F.col("selected_run_id").alias("superseded_by_run_id"), "raw_run_count"
    )
    current = runs.filter(F.col("current_candidate") == "true").select("run_id", GROUP)
    rows = lookup.attach(current, winners, GROUP, "raw_run_count", spread="run_id", how="inner")
    return rows.filter(F.col("run_id") != F.col("superseded_by_run_id"))


def tag_updates(
    superseded: DataFrame, transitions: DataFrame, generated_at: str, policy: cfg.SelectionPolicy
) -> DataFrame:
    """run_id and the map of tags to set. A transition wins over a supersession of the same run."""
    stamp = F.lit(generated_at)

    def tags(pairs: dict[str, Column]) -> Column:
        flat = [part for name, value in pairs.items() for part in (F.lit(name), value)]
        return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())

    old = superseded.select(
        "run_id",
        F.lit(0).alias("_turn"),
        tags(
            {
                "current_candidate": F.lit("false"),
                "candidate_status": F.lit("superseded"),
                "superseded_by_run_id": F.col("superseded_by_run_id"),
                "superseded_at": stamp,
            }
        ).alias("_tags"),
    )
    status, reason = F.col("new_candidate_status"), F.col("promotion_reason")
    is_selected = status == "selected"
    new = transitions.filter("action = 'update'").select(
        "run_id",
        F.lit(1).alias("_turn"),
        tags(
            {
                "candidate_status": status,
                "promotion_reason": reason,
                "promotion_evaluated_at": stamp,
                "candidate": F.col("candidate"),
                "current_candidate": F.col("current_candidate"),
                "candidate_policy_name": F.lit(policy.name),
                "candidate_policy_version": F.lit(policy.version),
                "promotion_rejection_reason": F.when(status == "rejected", reason),
                "promotion_eligible_reason": F.when(status == "eligible", reason),
                "baseline_run_id": F.when(is_selected, F.col("baseline_run_id")),
                "candidate_selected_at": F.when(is_selected, stamp),
                "promotion_evidence_status": F.when(is_selected, F.lit("passed")),
            }
        ).alias("_tags"),
    )
    both = old.unionByName(new)

    def of_turn(turn: int) -> Column:
        none = F.create_map().cast("map<string,string>")
        return F.coalesce(F.max_by("_tags", F.when(F.col("_turn") == turn, 1)), none)

    # At most one row of each turn per run.
    merged = both.groupBy("run_id").agg(
        of_turn(0).alias("a"), of_turn(1).alias("b")
    )
    return merged.select("run_id", _overlay("a", "b").alias("tag_updates"))


def _overlay(old: str, new: str) -> Column:
    return F.map_zip_with(old, new, lambda _, before, after: F.coalesce(after, before))


def apply_tag_updates(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """New snapshot of the runs' tag maps; both sides have one row per run."""
    rows = runs.join(updates, "run_id", "left")
    merged = F.when(F.col("tag_updates").isNull(), F.col("tags")).otherwise(_overlay("tags", "tag_updates"))
    return rows.withColumn("tags", merged).drop("tag_updates")


def current_state(events: DataFrame) -> DataFrame:
    """Latest selection per scope from the event log."""
    payload = F.struct("selected_run_id", "generated_at")
    return (
        events.groupBy("scope")
        .agg(
            F.max_by(payload, F.struct("generated_at", "selected_run_id")).alias("last"),
            F.count("*").alias("event_count"),
        )
        .select(
            "scope",
            F.col("last.selected_run_id").alias("current_candidate_run_id"),
            F.col("last.generated_at").alias("updated_at"),
            "event_count",
        )
    )


def run_status(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Status summary of every run; an absent or empty tag reads as its default."""
    # Default of each tag.
    defaults = {
        "candidate_status": "missing",
        "candidate": "false",
        "current_candidate": "false",
        "promotion_reason": "missing",
        "promotion_rejection_reason": "",
        "run_owner": "missing",
        "variant_name": "unknown",
        "comparison_group_id": "unknown",
    }

    def read(name: str) -> Column:
        return F.nullif(F.try_element_at("tags", F.lit(name)), F.lit(""))

    own_reason = F.coalesce(read("promotion_reason"), read("promotion_rejection_reason"))
    rows = runs.select(
        "run_id",
        *[F.coalesce(read(n), F.lit(d)).alias(n) for n, d in defaults.items()],
        own_reason.isNotNull().alias("has_reason"),
    )
    return rows.join(evidence.select("run_id", "evidence_status"), "run_id", "left")


def status_counts(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("candidate_status").agg(F.count("*").alias("run_count"))


def _status_problem() -> Column:
    selected = F.col("candidate_status") == "selected"
    bare = (F.col("candidate_status") == "rejected") & ~F.col("has_reason")
    return F.when(selected & (F.col("evidence_status") != "passed"), "selected_with_failed_evidence").when(
        bare, "rejected_without_reason"
    )


def status_problems(summaries: DataFrame) -> DataFrame:
    """Runs that break a status rule, one row each."""
    return summaries.select("run_id", _status_problem().alias("problem")).filter("problem IS NOT NULL")


def status_health(summaries: DataFrame) -> DataFrame:
    """One row: the three status rules and the overall status."""
    problem = _status_problem()
    counts = summaries.agg(
        F.count_if(F.col("current_candidate") == "true").alias("current_candidate_count"),
        F.count_if(problem == "selected_with_failed_evidence").alias("selected_with_failed_evidence"),
        F.count_if(problem == "rejected_without_reason").alias("rejected_without_reason"),
    )
    rules = counts.withColumns(
        {
            "single_current_candidate": F.col("current_candidate_count") <= 1,
            "selected_runs_have_passed_evidence": F.col("selected_with_failed_evidence") == 0,
            "rejected_runs_have_reason": F.col("rejected_without_reason") == 0,
        }
    )
    ok = (
        F.col("single_current_candidate")
        & F.col("selected_runs_have_passed_evidence")
        & F.col("rejected_runs_have_reason")
    )
    return rules.withColumn("status", F.when(ok, F.lit("passed")).otherwise(F.lit("failed")))
