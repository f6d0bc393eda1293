"""Queries over experiment runs: normalising, comparing, gating, selecting, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.oracle_base import case_map, define, query, sql_text
from catalog.registry import register
from siftline import config as cfg
from siftline.operators import comparison, selection, tuning
from siftline.plans import selection as plans
from siftline.sources import runs as source

POLICY = cfg.SelectionPolicy()
CONTRACT = cfg.EvidenceContract()
LIMITS = cfg.HistoryThresholds()
STAMP = "2026-02-01T00:00:00+00:00"
G = "comparison_group_id"
PINNED = cfg.CONTROLLED_VARIABLE_TAG
UNKNOWN = "('', 'unknown', 'missing')"

define("runs", (), inputs.RUNS.replace("SHA(", "sha256("))
define("baselines", ("runs",), inputs.BASELINES)
define("artifacts", ("runs",), inputs.ARTIFACTS)
define("plan", ("runs",), inputs.PLAN)
define("named", ("runs",), f"SELECT * FROM runs WHERE {G} NOT IN ('', 'unknown', 'missing', 'null')")
define(
    "completeness",
    ("named",),
    f"""SELECT r.*, NOT ({' OR '.join(f"(list_contains(vars, '{v}') AND coalesce({t}, 'unknown') IN {UNKNOWN})" for v, t in PINNED.items())}) AS complete
    FROM named r JOIN (SELECT {G}, [trim(x) FOR x IN string_split(controlled_variables, ',')] AS vars FROM named
      QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY start_time DESC, run_id) = 1) h USING ({G})""",
)
define(
    "kept",
    ("completeness",),
    f"""SELECT * EXCLUDE (complete, complete_n) FROM (SELECT *, count(*) FILTER (WHERE complete) OVER (PARTITION BY {G}) AS complete_n
      FROM completeness) WHERE complete OR complete_n < 2""",
)
define(
    "group_vars",
    ("kept",),
    f"""SELECT {G}, unnest([trim(x) FOR x IN string_split(controlled_variables, ',')]) AS v FROM (SELECT * FROM kept
      QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY start_time DESC, run_id) = 1)""",
)
define(
    "pinned_values",
    ("kept",),
    " UNION ALL ".join(
        f"SELECT {G}, '{v}' AS v, '{t}' AS tag, coalesce({t}, 'unknown') AS value FROM kept"
        for v, t in PINNED.items()
    ),
)
define(
    "variable_checks",
    ("group_vars", "pinned_values"),
    f"""SELECT h.{G}, h.v AS controlled_variable, coalesce(min(tag), '') AS tag,
      CASE WHEN min(tag) IS NULL THEN 'not_checked' WHEN count(DISTINCT value) = 1 AND min(value) NOT IN ('missing', 'unknown')
        THEN 'passed' ELSE 'failed' END AS status,
      CASE WHEN min(tag) IS NULL THEN NULL WHEN count(DISTINCT value) = 1 THEN min(value) ELSE 'mixed' END AS value
    FROM group_vars h LEFT JOIN pinned_values t ON t.{G} = h.{G} AND t.v = h.v GROUP BY h.{G}, h.v""",
)
define(
    "contract",
    ("kept", "variable_checks", "named"),
    f"""SELECT *, CASE WHEN single_comparison_type AND single_changed_variable AND controlled_variables_passed AND at_least_two_runs
      THEN 'valid' ELSE 'invalid' END AS comparison_status,
      CASE WHEN controlled_variables_passed THEN 'passed' ELSE 'failed' END AS controlled_variable_status
    FROM (SELECT {G}, count(*) AS run_count, TRUE AS single_comparison_group_id,
      count(DISTINCT comparison_type) = 1 AS single_comparison_type, count(DISTINCT changed_variable) = 1 AS single_changed_variable,
      count(*) >= 2 AS at_least_two_runs,
      CASE WHEN count(DISTINCT comparison_type) = 1 THEN min(comparison_type) ELSE 'mixed' END AS comparison_type,
      CASE WHEN count(DISTINCT changed_variable) = 1 THEN min(changed_variable) ELSE 'mixed' END AS changed_variable,
      CASE WHEN count(f1_macro) >= 2 THEN max(f1_macro) - min(f1_macro) END AS spread FROM kept GROUP BY {G})
    JOIN (SELECT {G}, bool_and(status = 'passed') AS controlled_variables_passed FROM variable_checks GROUP BY {G}) USING ({G})
    JOIN (SELECT {G}, count(*) AS raw_run_count FROM named GROUP BY {G}) USING ({G})""",
)
_CHECKS = ", ".join(comparison.CHECK_NAMES)
define(
    "best",
    ("kept",),
    " UNION ALL ".join(
        f"SELECT {G}, '{title}' AS title, '{metric}' AS metric_name, run_id, variant_name, {metric} AS metric_value, "
        f"combined_weakest_class_recall AS recall, low_confidence_rate AS low FROM kept WHERE {metric} IS NOT NULL "
        f"QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY {metric} {'DESC' if sign > 0 else 'ASC'}, start_time DESC, run_id) = 1"
        for title, metric, sign in cfg.BEST_RUN_METRICS
    ),
)
define(
    "failed_names",
    ("contract", "variable_checks"),
    f"""SELECT {G}, CASE WHEN comparison_status <> 'valid' THEN 'failed contract checks: ' || concat_ws(', ',
      {', '.join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in comparison.CHECK_NAMES)})
      || coalesce('; failed controlled variables: ' || names, '') END AS blocked_reason,
      concat_ws(', ', {', '.join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in comparison.CHECK_NAMES)}) AS failed_checks
    FROM contract LEFT JOIN (SELECT {G}, string_agg(DISTINCT controlled_variable, ', ' ORDER BY controlled_variable) AS names
      FROM variable_checks WHERE status = 'failed' GROUP BY {G}) USING ({G})""",
)
define(
    "advice",
    ("contract", "best", "failed_names"),
    f"""SELECT *, {case_map('recommendation_type', {k: v for k, (v, _) in comparison.ADVICE.items()})} AS recommended_next_experiment,
      CASE recommendation_type {' '.join(f"WHEN '{k}' THEN {sql_text(r)}" for k, (_, r) in comparison.ADVICE.items() if r)}
        ELSE blocked_reason END AS recommendation_reason,
      CASE recommendation_type WHEN 'rerun_invalid_comparison' THEN 'comparison_status=' || comparison_status || '; controlled_variable_status=' || controlled_variable_status
        WHEN 'data_or_feature_pipeline_experiment' THEN 'best_variant=' || f.variant_name || '; combined_weakest_class_recall=' || CAST(f.recall AS VARCHAR)
        WHEN 'confidence_or_feature_experiment' THEN 'best_variant=' || f.variant_name || '; low_confidence_rate=' || CAST(f.low AS VARCHAR)
        WHEN 'change_experiment_direction' THEN 'f1_macro_spread=' || CAST(round(spread, 4) AS VARCHAR) || '; meaningful_delta_threshold=0.02'
        WHEN 'quality_latency_tradeoff_experiment' THEN 'best_f1_variant=' || f.variant_name || '; best_latency_variant=' || l.variant_name
        WHEN 'candidate_selection' THEN 'best_f1_variant=' || f.variant_name || '; comparison_type=' || comparison_type || '; changed_variable=' || changed_variable
        ELSE 'missing best_f1_macro' END AS evidence,
      CASE WHEN f.run_id IS NULL THEN '{comparison._NO_TRADEOFF}' ELSE concat_ws(' | ',
        CASE WHEN f.run_id = l.run_id THEN '{comparison._SAME_LATENCY}' WHEN f.run_id <> l.run_id THEN '{comparison._OTHER_LATENCY}' END,
        CASE WHEN f.run_id = c.run_id THEN '{comparison._SAME_CONFIDENCE}' WHEN f.run_id <> c.run_id THEN '{comparison._OTHER_CONFIDENCE}' END) END AS tradeoffs,
      f.run_id AS best_f1_run_id
    FROM (SELECT k.*, n.blocked_reason, n.failed_checks, CASE WHEN comparison_status <> 'valid' THEN 'rerun_invalid_comparison'
        WHEN b.recall < 0.7 THEN 'data_or_feature_pipeline_experiment' WHEN b.low > 0.2 THEN 'confidence_or_feature_experiment'
        WHEN spread < 0.02e0 THEN 'change_experiment_direction' WHEN b.run_id <> d.run_id THEN 'quality_latency_tradeoff_experiment'
        WHEN b.run_id IS NOT NULL THEN 'candidate_selection' ELSE 'insufficient_metrics' END AS recommendation_type
      FROM contract k JOIN failed_names n USING ({G})
      LEFT JOIN best b ON b.{G} = k.{G} AND b.title = 'best_f1_macro' LEFT JOIN best d ON d.{G} = k.{G} AND d.title = 'best_latency_p95') x
    LEFT JOIN best f ON f.{G} = x.{G} AND f.title = 'best_f1_macro' LEFT JOIN best l ON l.{G} = x.{G} AND l.title = 'best_latency_p95'
    LEFT JOIN best c ON c.{G} = x.{G} AND c.title = 'best_low_confidence_rate'""",
)


def _groups(spark, sf):
    return comparison.summarize_groups(comparison.comparison_cells(inputs.runs(spark, sf)))


def _history(spark, sf):
    return plans.history_report(inputs.runs(spark, sf), LIMITS)


# --- S3, S4, C14: stored values ----------------------------------------------------------

_NORMAL = (
    "run_id, run_name, status, start_time, variant_name, comparison_group_id, comparison_type, changed_variable, "
    "controlled_variables, training_data_sha256, policy_sha256, experiment_config_sha256, model_family"
)


@register(
    "s3_normalize_runs",
    query(
        f"""SELECT run_id, run_name, status, start_time, variant_name, comparison_group_id, comparison_type, changed_variable,
          controlled_variables, coalesce(training_data_sha256, 'unknown') AS training_data_sha256,
          coalesce(policy_sha256, 'unknown') AS policy_sha256, experiment_config_sha256, model_family,
          f1_macro, low_confidence_rate, offline_decision_latency_p95_ms,
          concat_ws(',', {', '.join(f"'{k}=' || {k}" for k in sorted(inputs.PARAMS))}) AS params FROM runs""",
        "runs",
    ),
)
def s3(spark, sf):
    runs = source.normalize_runs(inputs.run_values(spark, sf))
    params = F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return runs.select(
        *_NORMAL.split(", "),
        "f1_macro",
        "low_confidence_rate",
        "offline_decision_latency_p95_ms",
        F.array_join(params, ",").alias("params"),
    )


@register(
    "s4_filter_by_tag",
    query("SELECT run_id, comparison_group_id, start_time FROM runs WHERE candidate_status = 'selected'", "runs"),
)
def s4(spark, sf):
    hit = source.filter_by_tag(inputs.runs(spark, sf), "candidate_status", "selected")
    return hit.select("run_id", G, "start_time")


@register(
    "c14_metric_table",
    query(f"SELECT run_id, {', '.join(inputs.METRICS)} FROM runs", "runs"),
)
def c14(spark, sf):
    return comparison.metric_table(inputs.run_values(spark, sf), inputs.METRICS)


# --- comparison --------------------------------------------------------------------------


@register(
    "c1_named_groups",
    query(f"SELECT {G}, count(*) AS run_count FROM named GROUP BY {G}", "named"),
)
def c1(spark, sf):
    named = comparison.usable_groups(inputs.runs(spark, sf))
    return named.groupBy(G).agg(F.count("*").alias("run_count"))


@register("c2_complete_runs", query(f"SELECT {G}, run_id, variant_name FROM kept", "kept"))
def c2(spark, sf):
    return comparison.complete_runs(inputs.runs(spark, sf)).select(G, "run_id", "variant_name")


@register("c3_controlled_variables", query("SELECT * FROM variable_checks", "variable_checks"))
def c3(spark, sf):
    return comparison.controlled_variable_checks(_groups(spark, sf))


@register(
    "c4_tag_values",
    query(
        f"SELECT DISTINCT {G}, coalesce(training_data_sha256, 'unknown') AS value FROM kept", "kept"
    ),
)
def c4(spark, sf):
    return comparison.tag_values(comparison.complete_runs(inputs.runs(spark, sf)), "training_data_sha256")


_CONTRACT = (
    f"{G}, comparison_status, comparison_type, changed_variable, run_count, raw_run_count, controlled_variable_status, {_CHECKS}"
)


@register("c5_comparison_contract", query(f"SELECT {_CONTRACT} FROM contract", "contract"))
def c5(spark, sf):
    return _groups(spark, sf).select(*_CONTRACT.split(", "))


@register(
    "c6_candidate_pool",
    query(
        f"SELECT {G}, run_id, k.variant_name, k.model_family, k.f1_macro, TRUE AS ready_for_candidate_selection FROM kept k "
        f"JOIN (SELECT {G} FROM contract WHERE comparison_status = 'valid') USING ({G})",
        "kept",
        "contract",
    ),
)
def c6(spark, sf):
    runs = inputs.runs(spark, sf)
    cells = comparison.comparison_cells(runs)
    pool = comparison.candidate_pool(comparison.complete_runs(runs, cells), comparison.summarize_groups(cells))
    return pool.select(G, "run_id", "variant_name", "model_family", "f1_macro", "ready_for_candidate_selection")


@register(
    "c7_best_runs",
    query(f"SELECT {G}, title, metric_name, run_id, variant_name, metric_value FROM best", "best"),
)
def c7(spark, sf):
    return comparison.best_runs(_groups(spark, sf))


@register("c8_tradeoffs", query(f"SELECT {G}, tradeoffs FROM advice", "advice"))
def c8(spark, sf):
    rows = comparison.with_tradeoffs(_groups(spark, sf))
    return rows.select(G, F.array_join("tradeoff_summary", " | ").alias("tradeoffs"))


@register(
    "c9_metric_spread",
    query(f"SELECT {G}, round(spread, 6) AS f1_macro_spread FROM contract", "contract"),
)
def c9(spark, sf):
    return _groups(spark, sf).select(G, F.round("f1_macro_spread", 6).alias("f1_macro_spread"))


@register("c10_blocked_reason", query(f"SELECT {G}, blocked_reason FROM failed_names", "failed_names"))
def c10(spark, sf):
    return _groups(spark, sf).select(G, "blocked_reason")


_ADVICE = f"{G}, recommendation_type, recommended_next_experiment, recommendation_reason, evidence"


@register("c11_next_experiment", query(f"SELECT {_ADVICE} FROM advice", "advice"))
def c11(spark, sf):
    return _history(spark, sf).withColumn("evidence", F.array_join("evidence", "; ")).select(*_ADVICE.split(", "))


@register(
    "c12_overall_next_step",
    query(
        f"""SELECT recommendation_type, recommended_next_experiment, recommendation_reason AS reason, {G} AS source_group_id FROM advice
        ORDER BY CASE WHEN comparison_status <> 'valid' THEN 0 WHEN recommendation_type <> 'candidate_selection' THEN 1 ELSE 2 END, {G} LIMIT 1""",
        "advice",
    ),
)
def c12(spark, sf):
    return comparison.overall_next_step(_history(spark, sf))


_REPORT = f"{G}, comparison_status, run_count, raw_run_count, comparison_type, changed_variable, controlled_variable_status, best_f1_run_id, blocked_reason, recommendation_type"


@register("c13_history_groups", query(f"SELECT {_REPORT} FROM advice", "advice"))
def c13_groups(spark, sf):
    rows = _history(spark, sf).withColumn("best_f1_run_id", F.col("best_f1_macro.run_id"))
    return rows.select(*_REPORT.split(", "))


@register(
    "c13_history_totals",
    query(
        """SELECT count(*) AS total_comparison_groups, count(*) FILTER (WHERE comparison_status = 'valid') AS valid_comparison_groups,
          count(*) FILTER (WHERE comparison_status <> 'valid') AS invalid_comparison_groups,
          count(*) FILTER (WHERE comparison_status = 'valid') AS ready_for_candidate_selection_groups FROM contract""",
        "contract",
    ),
)
def c13_totals(spark, sf):
    return comparison.history_totals(_groups(spark, sf))


@register(
    "c15_config_drift",
    query(
        """SELECT run_id, concat_ws(',',
          CASE WHEN tfidf AND max_features IS NOT NULL THEN 'max_features' END,
          CASE WHEN tfidf AND ngram_range <> '[1, 1]' THEN 'ngram_range' END,
          CASE WHEN changed_variable NOT IN ('random_state', 'seed') AND random_state <> '42' THEN 'random_state' END,
          CASE WHEN changed_variable NOT IN ('model_max_iter', 'max_iter') AND model_max_iter IS DISTINCT FROM '1000' THEN 'model_max_iter' END) AS drift
        FROM (SELECT *, changed_variable NOT IN ('feature_pipeline', 'vectorizer', 'vectorizer_name', 'vectorizer_params',
          'tfidf_max_features', 'tfidf_ngram_range') AS tfidf FROM runs)""",
        "runs",
    ),
)
def c15(spark, sf):
    rows = comparison.config_drift(inputs.runs(spark, sf), cfg.TrainingSettings())
    return rows.select("run_id", F.array_join("drift", ",").alias("drift"))


# --- gating and selection ----------------------------------------------------------------


def _status_sql(rule) -> str:
    op = ">=" if rule.at_least else "<="
    return f"CASE WHEN {rule.metric} IS NULL THEN 'missing' WHEN {rule.metric} {op} {rule.threshold}e0 THEN 'passed' ELSE 'failed' END"


_RULES = sorted(POLICY.thresholds, key=lambda r: r.metric)


def _names_sql(status: str) -> str:
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {_status_sql(r)} = '{status}' THEN '{r.metric}' END" for r in _RULES
    ) + ")"


define(
    "verdicts",
    ("runs",),
    f"""SELECT run_id, CASE WHEN missing <> '' THEN 'human_review_required' WHEN failed <> '' THEN 'candidate_rejected' ELSE 'candidate_ready' END AS policy_decision,
      CASE WHEN missing <> '' THEN 'missing_required_metrics: ' || missing WHEN failed <> '' THEN 'failed_threshold_checks: ' || failed
        ELSE '{selection.ALL_PASSED}' END AS policy_reason
    FROM (SELECT run_id, {_names_sql('missing')} AS missing, {_names_sql('failed')} AS failed FROM runs)""",
)
define(
    "against_baseline",
    ("kept", "baselines", "runs"),
    f"""SELECT k.{G}, k.run_id, baseline_run_id, k.f1_macro - b.f1_macro AS gain,
      CASE WHEN k.f1_macro IS NULL OR b.f1_macro IS NULL THEN 'human_review_required' WHEN k.f1_macro >= b.f1_macro + 0.02e0 THEN 'candidate_ready'
        ELSE 'candidate_rejected' END AS baseline_decision,
      CASE WHEN k.f1_macro IS NULL OR b.f1_macro IS NULL THEN '{selection.NO_BASELINE_F1}' || concat_ws(', ', CASE WHEN k.f1_macro IS NULL THEN 'candidate.f1_macro' END,
          CASE WHEN b.f1_macro IS NULL THEN 'baseline.f1_macro' END)
        WHEN k.f1_macro >= b.f1_macro + 0.02e0 THEN '{selection.ENOUGH_GAIN}' ELSE '{selection.TOO_LITTLE_GAIN}' END AS baseline_reason
    FROM kept k JOIN baselines USING ({G}) LEFT JOIN runs b ON b.run_id = baseline_run_id""",
)


def _absent_sql(names) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN coalesce(CAST({n} AS VARCHAR), '') = '' THEN '{n}' END" for n in names
    ) + ")"


define(
    "evidence",
    ("runs", "artifacts"),
    f"""SELECT *, CASE WHEN missing_params = '' AND missing_metrics = '' AND missing_tags = '' AND missing_artifacts = '' THEN 'passed' ELSE 'failed' END AS evidence_status
    FROM (SELECT run_id, {_absent_sql(CONTRACT.params)} AS missing_params, {_absent_sql(CONTRACT.metrics)} AS missing_metrics,
      {_absent_sql(CONTRACT.tags)} AS missing_tags,
      concat_ws(',', CASE WHEN NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.run_id = r.run_id AND (path = 'manifest.json' OR path LIKE '%/manifest.json')) THEN 'manifest.json' END,
        CASE WHEN NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.run_id = r.run_id AND (path = 'promotion_report.md' OR path LIKE '%/promotion_report.md')) THEN 'promotion_report.md' END) AS missing_artifacts
    FROM runs r)""",
)
define(
    "evaluations",
    ("against_baseline", "verdicts", "evidence"),
    f"""SELECT *, CASE WHEN eligible THEN 'candidate_ready' ELSE 'candidate_rejected' END AS decision,
      CASE WHEN run_id = baseline_run_id THEN '{selection.IS_BASELINE}' WHEN eligible THEN '{selection.ELIGIBLE}' ELSE
        concat_ws('; ', CASE WHEN policy_decision <> 'candidate_ready' THEN policy_reason END, CASE WHEN baseline_decision <> 'candidate_ready' THEN baseline_reason END,
          CASE WHEN evidence_status <> 'passed' THEN '{selection.EVIDENCE_FAILED}' END) END AS evaluation_reason
    FROM (SELECT *, run_id <> baseline_run_id AND policy_decision = 'candidate_ready' AND baseline_decision = 'candidate_ready' AND evidence_status = 'passed' AS eligible
      FROM against_baseline JOIN verdicts USING (run_id) JOIN evidence USING (run_id))""",
)
define(
    "winners",
    ("evaluations", "runs"),
    f"""SELECT e.{G}, run_id AS selected_run_id, variant_name AS selected_variant_name, evaluation_reason AS selected_reason
    FROM evaluations e JOIN (SELECT * EXCLUDE ({G}) FROM runs) USING (run_id) WHERE eligible
    QUALIFY row_number() OVER (PARTITION BY e.{G} ORDER BY f1_macro DESC NULLS LAST, offline_decision_latency_p95_ms NULLS LAST,
      low_confidence_rate NULLS LAST, approval_required_rate NULLS LAST, start_time, run_id) = 1""",
)
define(
    "guard",
    ("baselines", "named"),
    f"""SELECT *, CASE WHEN current_count = 0 OR baseline_run_id = current_run_id AND current_count = 1 THEN 'passed' WHEN current_count > 1 THEN 'failed'
        WHEN allow_override AND override_reason IS NOT NULL THEN 'passed_with_override' ELSE 'failed' END AS guard_status,
      CASE WHEN current_count = 0 THEN 'bootstrap_no_current_candidate' WHEN current_count > 1 THEN 'ambiguous_current_candidate'
        WHEN baseline_run_id = current_run_id THEN 'baseline_matches_current_candidate'
        WHEN allow_override AND override_reason IS NOT NULL THEN 'non_current_baseline_override' ELSE 'baseline_mismatch' END AS guard_mode
    FROM baselines JOIN (SELECT {G}, count(*) FILTER (WHERE current_candidate = 'true') AS current_count,
      min(CASE WHEN current_candidate = 'true' THEN run_id END) AS current_run_id FROM named GROUP BY {G}) USING ({G})""",
)
define(
    "report",
    ("guard", "winners", "contract"),
    f"""SELECT *, CASE WHEN guard_status = 'failed' THEN 'blocked_by_baseline_guard' WHEN selected_run_id IS NOT NULL THEN 'selected' ELSE 'no_candidate_selected' END AS selection_status
    FROM (SELECT {G}, comparison_status, guard_status, guard_mode, current_count, current_run_id, baseline_run_id,
      CASE WHEN guard_status <> 'failed' AND comparison_status = 'valid' THEN w.selected_run_id END AS selected_run_id,
      CASE WHEN guard_status <> 'failed' AND comparison_status = 'valid' THEN w.selected_variant_name END AS selected_variant_name,
      CASE WHEN guard_status <> 'failed' AND comparison_status = 'valid' THEN w.selected_reason END AS selected_reason
    FROM contract JOIN guard USING ({G}) LEFT JOIN winners w USING ({G}))""",
)
define(
    "transitions",
    ("evaluations", "report", "runs"),
    f"""SELECT run_id, variant_name, baseline_run_id,
      CASE WHEN skip THEN 'skip' ELSE 'update' END AS action,
      CASE WHEN skip THEN NULL WHEN sel THEN 'selected' WHEN eligible THEN 'eligible' ELSE 'rejected' END AS new_candidate_status,
      CASE WHEN skip THEN '{selection.BASELINE_UNCHANGED}' WHEN sel THEN evaluation_reason WHEN eligible THEN '{selection.NOT_BEST}' ELSE evaluation_reason END AS promotion_reason,
      CASE WHEN skip THEN NULL WHEN sel THEN 'true' ELSE 'false' END AS current_candidate
    FROM (SELECT e.*, r.variant_name, coalesce(e.run_id = selected_run_id, FALSE) AS sel,
        e.run_id = e.baseline_run_id AND NOT coalesce(e.run_id = selected_run_id, FALSE) AS skip
      FROM evaluations e JOIN (SELECT {G}, selected_run_id FROM report) USING ({G}) JOIN (SELECT run_id, variant_name FROM runs) r USING (run_id))""",
)
define(
    "superseded",
    ("named", "report"),
    f"SELECT run_id, {G}, selected_run_id AS superseded_by_run_id FROM (SELECT run_id, {G} FROM named WHERE current_candidate = 'true') "
    f"JOIN (SELECT {G}, selected_run_id FROM report WHERE selected_run_id IS NOT NULL) USING ({G}) WHERE run_id <> selected_run_id",
)


def _selection(spark, sf):
    return plans.select_candidates(
        inputs.runs(spark, sf), inputs.run_artifacts(spark, sf), inputs.baselines(spark, sf), POLICY, CONTRACT
    )


@register(
    "k1_threshold_checks",
    query(
        " UNION ALL ".join(
            f"SELECT run_id, '{r.metric}' AS metric_name, '{'gte' if r.at_least else 'lte'}' AS comparison, {r.threshold}e0 AS threshold, "
            f"{r.metric} AS value, {_status_sql(r)} AS status FROM runs"
            for r in POLICY.thresholds
        ),
        "runs",
    ),
)
def k1(spark, sf):
    return selection.threshold_checks(inputs.runs(spark, sf), POLICY)


@register("k2_run_verdict", query("SELECT * FROM verdicts", "verdicts"))
def k2(spark, sf):
    rows = selection.with_verdict(inputs.runs(spark, sf), POLICY)
    return rows.select("run_id", "policy_decision", "policy_reason")


@register(
    "k3_compare_to_baseline",
    query(
        "SELECT run_id, baseline_run_id, baseline_decision, baseline_reason, round(gain, 6) AS actual_improvement FROM against_baseline",
        "against_baseline",
    ),
)
def k3(spark, sf):
    runs = inputs.runs(spark, sf)
    rows = selection.with_baseline(comparison.complete_runs(runs), inputs.baselines(spark, sf), runs)
    rows = selection.compare_to_baseline(rows, POLICY)
    return rows.select(
        "run_id", "baseline_run_id", "baseline_decision", "baseline_reason", F.round("actual_improvement", 6).alias("actual_improvement")
    )


@register("k4_promotion_evidence", query("SELECT * FROM evidence", "evidence"))
def k4(spark, sf):
    rows = selection.check_evidence(inputs.runs(spark, sf), inputs.run_artifacts(spark, sf), CONTRACT)
    lists = [f"missing_{kind}" for kind in ("params", "metrics", "tags", "artifacts")]
    return rows.select("run_id", *[F.array_join(c, ",").alias(c) for c in lists], "evidence_status")


@register(
    "k5_candidate_evaluations",
    query("SELECT run_id, eligible, decision, evaluation_reason, policy_decision, baseline_decision, evidence_status FROM evaluations", "evaluations"),
)
def k5(spark, sf):
    return _selection(spark, sf).evaluations.select(
        "run_id", "eligible", "decision", "evaluation_reason", "policy_decision", "baseline_decision", "evidence_status"
    )


@register("k6_select_candidate", query("SELECT * FROM winners", "winners"))
def k6(spark, sf):
    return selection.select_candidates(_selection(spark, sf).evaluations)


@register(
    "k7_baseline_guard",
    query(f"SELECT {G}, baseline_run_id, current_count, guard_status, guard_mode FROM guard", "guard"),
)
def k7(spark, sf):
    current = selection.current_candidates(comparison.usable_groups(inputs.runs(spark, sf)))
    rows = selection.baseline_guard(inputs.baselines(spark, sf), current)
    return rows.select(G, "baseline_run_id", "current_count", "guard_status", "guard_mode")


_SELECTION = f"{G}, comparison_status, guard_status, guard_mode, baseline_run_id, selected_run_id, selected_variant_name, selected_reason, selection_status"


@register("k8_selection_report", query(f"SELECT {_SELECTION} FROM report", "report"))
def k8(spark, sf):
    return _selection(spark, sf).report.select(*_SELECTION.split(", "))


@register(
    "k9_status_transitions",
    query("SELECT run_id, variant_name, action, new_candidate_status, promotion_reason, current_candidate FROM transitions", "transitions"),
)
def k9(spark, sf):
    return _selection(spark, sf).transitions.select(
        "run_id", "variant_name", "action", "new_candidate_status", "promotion_reason", "current_candidate"
    )


@register(
    "k10_lifecycle",
    query(
        f"""SELECT {G}, selected_run_id AS new_current_candidate_run_id, current_count AS previous_current_count,
          coalesce(current_count = 1 AND current_run_id = selected_run_id, FALSE) AS already_current FROM report""",
        "report",
    ),
)
def k10(spark, sf):
    return _selection(spark, sf).lifecycle


@register("k10_superseded_runs", query("SELECT * FROM superseded", "superseded"))
def k10_superseded(spark, sf):
    return selection.superseded_runs(
        comparison.usable_groups(inputs.runs(spark, sf)), _selection(spark, sf).report
    )


@register(
    "k11_apply_tags",
    query(
        f"""SELECT r.run_id, coalesce(t.new_candidate_status, CASE WHEN s.run_id IS NOT NULL THEN 'superseded' END, r.candidate_status) AS candidate_status,
          coalesce(t.current_candidate, CASE WHEN s.run_id IS NOT NULL THEN 'false' END, r.current_candidate) AS current_candidate,
          coalesce(t.promotion_reason, r.promotion_reason) AS promotion_reason, s.superseded_by_run_id,
          CASE WHEN t.new_candidate_status = 'rejected' THEN t.promotion_reason END AS promotion_rejection_reason,
          CASE WHEN t.new_candidate_status = 'selected' THEN t.baseline_run_id END AS baseline_run_id,
          CASE WHEN t.run_id IS NOT NULL THEN '{STAMP}' END AS promotion_evaluated_at
        FROM runs r LEFT JOIN (SELECT * FROM transitions WHERE action = 'update') t USING (run_id) LEFT JOIN superseded s USING (run_id)""",
        "runs",
        "transitions",
        "superseded",
    ),
)
def k11(spark, sf):
    runs = inputs.runs(spark, sf)
    chosen = _selection(spark, sf)
    old = selection.superseded_runs(comparison.usable_groups(runs), chosen.report)
    updates = selection.tag_updates(old, chosen.transitions, STAMP, POLICY)
    rows = selection.apply_tag_updates(runs.select("run_id", "tags"), updates)
    names = (
        "candidate_status",
        "current_candidate",
        "promotion_reason",
        "superseded_by_run_id",
        "promotion_rejection_reason",
        "baseline_run_id",
        "promotion_evaluated_at",
    )
    return rows.select("run_id", *[F.try_element_at("tags", F.lit(n)).alias(n) for n in names])


@register(
    "s5_selection_events",
    query(
        f"SELECT 'candidate_selected' AS event_type, '{STAMP}' AS generated_at, {G} AS scope, selected_run_id, baseline_run_id, "
        f"'{POLICY.name}' AS policy_name, 'v1' AS policy_version FROM report WHERE selection_status = 'selected'",
        "report",
    ),
)
def s5(spark, sf):
    return source.selection_events(_selection(spark, sf).report, STAMP, POLICY.name, POLICY.version)


@register(
    "k12_current_state",
    query(
        f"""SELECT {G} AS scope, run_id AS current_candidate_run_id, start_time AS updated_at, event_count FROM
        (SELECT *, count(*) OVER (PARTITION BY {G}) AS event_count FROM runs WHERE candidate_status = 'selected')
        QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY start_time DESC, run_id DESC) = 1""",
        "runs",
    ),
)
def k12(spark, sf):
    events = source.filter_by_tag(inputs.runs(spark, sf), "candidate_status", "selected").select(
        F.col(G).alias("scope"), F.col("start_time").alias("generated_at"), F.col("run_id").alias("selected_run_id")
    )
    return selection.current_state(events)


define(
    "summaries",
    ("runs", "evidence"),
    "SELECT run_id, coalesce(candidate_status, 'missing') AS candidate_status, candidate, current_candidate, "
    "coalesce(promotion_reason, 'missing') AS promotion_reason, coalesce(run_owner, 'missing') AS run_owner, variant_name, "
    "comparison_group_id, promotion_reason IS NOT NULL AS has_reason, evidence_status FROM runs JOIN evidence USING (run_id)",
)
define(
    "problems",
    ("summaries",),
    "SELECT run_id, CASE WHEN candidate_status = 'selected' AND evidence_status <> 'passed' THEN 'selected_with_failed_evidence' "
    "WHEN candidate_status = 'rejected' AND NOT has_reason THEN 'rejected_without_reason' END AS problem FROM summaries",
)


def _summaries(spark, sf):
    runs = inputs.runs(spark, sf)
    evidence = selection.check_evidence(runs, inputs.run_artifacts(spark, sf), CONTRACT)
    return selection.run_status(runs, evidence)


@register(
    "k13_run_status",
    query("SELECT *, '' AS promotion_rejection_reason FROM summaries", "summaries"),
)
def k13(spark, sf):
    return _summaries(spark, sf)


@register(
    "k13_status_counts",
    query("SELECT candidate_status, count(*) AS run_count FROM summaries GROUP BY 1", "summaries"),
)
def k13_counts(spark, sf):
    return selection.status_counts(_summaries(spark, sf))


@register("k14_status_problems", query("SELECT * FROM problems WHERE problem IS NOT NULL", "problems"))
def k14_problems(spark, sf):
    return selection.status_problems(_summaries(spark, sf))


@register(
    "k14_status_health",
    query(
        """SELECT *, current_candidate_count <= 1 AS single_current_candidate, selected_with_failed_evidence = 0 AS selected_runs_have_passed_evidence,
          rejected_without_reason = 0 AS rejected_runs_have_reason,
          CASE WHEN current_candidate_count <= 1 AND selected_with_failed_evidence = 0 AND rejected_without_reason = 0 THEN 'passed' ELSE 'failed' END AS status
        FROM (SELECT count(*) FILTER (WHERE current_candidate = 'true') AS current_candidate_count,
          count(*) FILTER (WHERE problem = 'selected_with_failed_evidence') AS selected_with_failed_evidence,
          count(*) FILTER (WHERE problem = 'rejected_without_reason') AS rejected_without_reason FROM summaries JOIN problems USING (run_id))""",
        "summaries",
        "problems",
    ),
)
def k14(spark, sf):
    return selection.status_health(_summaries(spark, sf))


define(
    "tuned",
    ("plan", "contract", "failed_names", "kept"),
    f"""SELECT *, CASE WHEN blocked_reason IS NULL THEN 'valid' ELSE 'blocked' END AS status FROM
    (SELECT p.*, CASE WHEN p.{G} LIKE '<%' THEN 'comparison_group_id is a placeholder' WHEN c.{G} IS NULL THEN 'no runs found for comparison_group_id'
        WHEN comparison_status <> 'valid' THEN 'comparison contract invalid: ' || failed_checks WHEN w.run_id IS NULL THEN 'missing winner metric: f1_macro' END AS blocked_reason,
      CASE WHEN p.{G} LIKE '<%' THEN 'blocked' ELSE coalesce(comparison_status, 'blocked') END AS comparison_status, coalesce(raw_run_count, 0) AS raw_run_count,
      w.run_id AS w_run_id, w.variant_name AS w_variant, w.f1_macro AS w_value, w.model_max_iter AS w_iter
    FROM plan p LEFT JOIN contract c USING ({G}) LEFT JOIN failed_names n USING ({G})
    LEFT JOIN (SELECT * FROM kept WHERE f1_macro IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {G} ORDER BY f1_macro DESC, start_time DESC, run_id) = 1) w USING ({G}))""",
)


def _experiments(spark, sf):
    runs = inputs.runs(spark, sf)
    cells = comparison.comparison_cells(runs)
    winners = tuning.group_winners(comparison.complete_runs(runs, cells), "f1_macro")
    return tuning.summarize_experiments(
        inputs.tuning_plan(spark, sf), comparison.summarize_groups(cells), winners, "f1_macro"
    )


@register(
    "k15_tuning_winners",
    query(
        f"""SELECT label, {G}, changed_parameter, status, comparison_status, blocked_reason, raw_run_count,
          CASE WHEN status = 'valid' THEN w_run_id END AS winner_run_id, CASE WHEN status = 'valid' THEN w_variant END AS winner_variant_name,
          CASE WHEN status = 'valid' THEN w_value END AS winner_metric_value FROM tuned""",
        "tuned",
    ),
)
def k15(spark, sf):
    return _experiments(spark, sf).select(
        "label", G, "changed_parameter", "status", "comparison_status", "blocked_reason", "raw_run_count",
        "winner_run_id", "winner_variant_name", "winner_metric_value",
    )


@register(
    "k16_combined_draft",
    query(
        """SELECT changed_parameter, w_run_id AS winner_run_id, w_iter AS winner_max_iter, winner_count FROM
        (SELECT *, count(*) OVER (PARTITION BY changed_parameter) AS winner_count FROM tuned WHERE status = 'valid')
        QUALIFY row_number() OVER (PARTITION BY changed_parameter ORDER BY position DESC) = 1""",
        "tuned",
    ),
)
def k16_draft(spark, sf):
    draft = tuning.combined_draft(_experiments(spark, sf))
    return draft.select(
        "changed_parameter", "winner_run_id",
        F.try_element_at("winner_params", F.lit("model_max_iter")).alias("winner_max_iter"), "winner_count",
    )


@register(
    "k16_plan_status",
    query(
        """SELECT count(*) AS experiment_count, count(*) FILTER (WHERE status = 'valid') AS winner_count,
          count(*) FILTER (WHERE status = 'blocked') AS blocked_count, (SELECT label FROM tuned WHERE status = 'blocked' ORDER BY position LIMIT 1) AS first_blocked_label,
          'blocked' AS status, 'fix_blocked_parameter_experiments' AS next_step, 'final_candidate_tournament' AS recommended_experiment_name FROM tuned""",
        "tuned",
    ),
)
def k16(spark, sf):
    return tuning.plan_status(_experiments(spark, sf))


@register("k16_blocked_labels", query("SELECT position, label FROM tuned WHERE status = 'blocked'", "tuned"))
def k16_blocked(spark, sf):
    return tuning.blocked_experiments(_experiments(spark, sf))
