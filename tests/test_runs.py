"""Run comparison, selection, lifecycle and tuning on hand-made runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.operators import audit, comparison, selection, tuning
from siftline.plans import selection as plans
from siftline.sources import runs as source

TAGS = ("run_id", "comparison_group_id", "variant_name", "start_time", "comparison_type", "changed_variable", "controlled_variables",
        "current_candidate", *cfg.CONTROLLED_VARIABLE_TAG.values())
METRICS = ("f1_macro", "combined_accuracy", "combined_weakest_class_recall", "low_confidence_rate", "approval_required_rate",
           "offline_decision_latency_p95_ms")
SCHEMA = ", ".join([f"{t} string" for t in TAGS] + [f"{m} double" for m in METRICS])
ALL = "raw_data,train_split,test_split,feature_pipeline,policy,evaluation_code"


def run(run_id, group="g", f1=0.9, **changes):
    values = dict(run_id=run_id, comparison_group_id=group, variant_name=f"variant {run_id}", start_time=f"2026-01-01 00:00:{len(run_id):02d}",
                  comparison_type="model_family", changed_variable="model_family", controlled_variables=ALL, current_candidate="false",
                  f1_macro=f1, combined_accuracy=f1, combined_weakest_class_recall=0.9, low_confidence_rate=0.1, approval_required_rate=0.3,
                  offline_decision_latency_p95_ms=10.0)
    values |= {t: f"{t}-{group}" for t in cfg.CONTROLLED_VARIABLE_TAG.values()}
    values |= changes
    return tuple(values[c] for c in (*TAGS, *METRICS))


def frame(spark, *rows):
    out = spark.createDataFrame(list(rows), SCHEMA)
    return out.withColumn("params", F.create_map(F.lit("p"), F.col("run_id")))


def report(spark, *rows):
    return {r.comparison_group_id: r for r in plans.history_report(frame(spark, *rows)).collect()}


def test_contract_and_advice_of_many_groups(spark):
    out = report(
        spark,
        run("a1", "clean", 0.95), run("a2", "clean", 0.8),
        run("b1", "single"),
        run("c1", "differs"), run("c2", "differs", policy_sha256="other"),
        run("d1", "weak", 0.95, combined_weakest_class_recall=0.6), run("d2", "weak", 0.8),
        run("e1", "unsure", 0.95, low_confidence_rate=0.35), run("e2", "unsure", 0.8),
        run("f1", "close", 0.9), run("f2", "close", 0.89),
        run("h1", "slow", 0.95, offline_decision_latency_p95_ms=30.0), run("h2", "slow", 0.8),
        run("i1", "bare", None), run("i2", "bare", None),
        run("j1", "unmapped", controlled_variables=ALL + ",hardware"), run("j2", "unmapped", controlled_variables=ALL + ",hardware"),
        run("k1", "types", comparison_type="ablation"), run("k2", "types"),
        run("l1", "nothing", controlled_variables=""), run("l2", "nothing", controlled_variables=""),
        run("u1", "unknown"), run("u2", ""),
    )
    assert set(out) == {"clean", "single", "differs", "weak", "unsure", "close", "slow", "bare", "unmapped", "types", "nothing"}
    kinds = {g: r.recommendation_type for g, r in out.items()}
    assert kinds == {
        "clean": "candidate_selection", "single": "rerun_invalid_comparison", "differs": "rerun_invalid_comparison",
        "weak": "data_or_feature_pipeline_experiment", "unsure": "confidence_or_feature_experiment", "close": "change_experiment_direction",
        "slow": "quality_latency_tradeoff_experiment", "bare": "insufficient_metrics", "unmapped": "rerun_invalid_comparison",
        "types": "rerun_invalid_comparison", "nothing": "rerun_invalid_comparison"}
    assert out["clean"].blocked_reason is None and out["clean"].comparison_status == "valid"
    assert "at_least_two_runs" in out["single"].blocked_reason
    assert out["differs"].blocked_reason == "failed contract checks: controlled_variables_passed; failed controlled variables: policy"
    assert out["unmapped"].blocked_reason == "failed contract checks: controlled_variables_passed"
    assert out["types"].comparison_type == "mixed"
    assert out["unsure"].evidence == ["best_variant=variant e1", "low_confidence_rate=0.35"]
    assert out["close"].evidence[0] == "f1_macro_spread=0.01"


def test_incomplete_runs_leave_unless_too_few_remain(spark):
    rows = frame(
        spark,
        run("a1", "drop"), run("a2", "drop"), run("a3", "drop", policy_sha256=None),
        run("b1", "stay"), run("b2", "stay", policy_sha256=None), run("b3", "stay", policy_sha256="unknown"),
    )
    kept = {r.run_id for r in comparison.complete_runs(rows).collect()}
    assert kept == {"a1", "a2", "b1", "b2", "b3"}


def test_first_step_and_totals(spark):
    groups = plans.history_report(frame(spark, run("a1", "x", 0.95), run("a2", "x", 0.8), run("b1", "y")))
    assert comparison.overall_next_step(groups).first().source_group_id == "y"
    totals = comparison.history_totals(groups).first()
    assert (totals.total_comparison_groups, totals.valid_comparison_groups) == (2, 1)
    nothing = comparison.overall_next_step(groups.limit(0)).first()
    assert nothing.recommendation_type == "no_experiments_found" and nothing.source_group_id is None


def test_published_tournament(spark):
    """The published comparison: logistic regression wins quality, the other family is faster."""
    rows = frame(
        spark,
        run("lr", "tournament", 1.0, combined_weakest_class_recall=1.0, low_confidence_rate=0.1, approval_required_rate=0.5,
            offline_decision_latency_p95_ms=2.9333, start_time="2026-07-15 09:40:19"),
        run("sgd", "tournament", 0.3718, combined_accuracy=0.5, combined_weakest_class_recall=0.0, low_confidence_rate=0.3,
            approval_required_rate=0.9, offline_decision_latency_p95_ms=2.2933, start_time="2026-07-15 09:40:15"),
    )
    row = comparison.with_tradeoffs(comparison.summarize_groups(comparison.comparison_cells(rows))).first()
    assert row.comparison_status == "valid"
    assert (row.best_f1_macro.run_id, row.best_latency_p95.run_id, row.best_latency_p95.value) == ("lr", "sgd", 2.2933)
    assert row.tradeoff_summary == [comparison._OTHER_LATENCY, comparison._SAME_CONFIDENCE]
    verdicts = {r.run_id: r.policy_decision for r in selection.with_verdict(rows, cfg.SelectionPolicy()).collect()}
    assert verdicts == {"lr": "candidate_ready", "sgd": "candidate_rejected"}
    base = spark.createDataFrame([("tournament", "sgd", False, None)],
                                 "comparison_group_id string, baseline_run_id string, allow_override boolean, override_reason string")
    evidence = rows.select("run_id", F.lit("passed").alias("evidence_status"))
    evaluated = selection.evaluate_candidates(rows, evidence, base, rows, cfg.SelectionPolicy())
    assert selection.select_candidates(evaluated).first().selected_run_id == "lr"
    assert {r.run_id: r.evaluation_reason for r in evaluated.collect()} == {"lr": selection.ELIGIBLE, "sgd": selection.IS_BASELINE}


def test_threshold_statuses(spark):
    rows = frame(spark, run("ok"), run("low", f1=0.5, low_confidence_rate=0.9), run("gone", f1=None), run("nan", f1=float("nan")))
    out = {r.run_id: r for r in selection.with_verdict(rows, cfg.SelectionPolicy()).collect()}
    assert out["ok"].policy_reason == selection.ALL_PASSED
    assert out["low"].policy_reason == "failed_threshold_checks: f1_macro, low_confidence_rate"
    assert (out["gone"].policy_decision, out["gone"].policy_reason) == ("human_review_required", "missing_required_metrics: f1_macro")
    assert out["nan"].policy_decision == "candidate_rejected"


def test_selection_order_guard_and_transitions(spark):
    runs = frame(
        spark,
        run("base", f1=0.80), run("slow", f1=0.9, offline_decision_latency_p95_ms=30.0), run("fast", f1=0.9), run("same", f1=0.81),
        run("other", "h", f1=0.80, current_candidate="true"), run("wins", "h", f1=0.9),
        run("p", "i", f1=0.8, current_candidate="true"), run("q", "i", f1=0.9, current_candidate="true"),
        run("old", "j", f1=0.7, current_candidate="true"), run("jb", "j", f1=0.8), run("new", "j", f1=0.95),
    ).withColumns({"metrics": F.create_map(F.lit("f"), F.lit(1.0)), "tags": F.create_map(F.lit("t"), F.lit("x"), F.lit("current_candidate"), F.col("current_candidate"))})
    baselines = spark.createDataFrame(
        [("g", "base", False, None), ("h", "other", False, None), ("i", "p", True, "because"), ("j", "jb", True, "because")],
        "comparison_group_id string, baseline_run_id string, allow_override boolean, override_reason string")
    artifacts = runs.select("run_id", F.lit("deep/manifest.json").alias("path"))
    contract = cfg.EvidenceContract(params=("p",), metrics=("f",), tags=("t",), artifacts=("manifest.json",))
    chosen = plans.select_candidates(runs, artifacts, baselines, contract=contract)
    report = {r.comparison_group_id: r for r in chosen.report.collect()}
    assert {g: (r.selection_status, r.selected_run_id, r.guard_mode) for g, r in report.items()} == {
        "g": ("selected", "fast", "bootstrap_no_current_candidate"),
        "h": ("selected", "wins", "baseline_matches_current_candidate"),
        "i": ("blocked_by_baseline_guard", None, "ambiguous_current_candidate"),
        "j": ("selected", "new", "non_current_baseline_override")}
    moves = {r.run_id: (r.action, r.new_candidate_status) for r in chosen.transitions.collect()}
    assert moves["base"] == ("skip", None) and moves["fast"] == ("update", "selected")
    assert moves["slow"] == ("update", "eligible") and moves["same"] == ("update", "rejected") and moves["old"] == ("update", "rejected")
    old = selection.superseded_runs(runs, chosen.report)
    assert {(r.run_id, r.superseded_by_run_id) for r in old.collect()} == {("other", "wins"), ("old", "new")}
    updates = selection.tag_updates(old, chosen.transitions, "now", cfg.SelectionPolicy())
    tags = {r.run_id: r.tags for r in selection.apply_tag_updates(runs.select("run_id", "tags"), updates).collect()}
    assert tags["other"]["candidate_status"] == "superseded" and tags["other"]["current_candidate"] == "false"
    assert tags["old"]["candidate_status"] == "rejected" and tags["old"]["superseded_by_run_id"] == "new"
    assert tags["wins"]["current_candidate"] == "true" and tags["base"] == {"t": "x", "current_candidate": "false"}
    life = {r.comparison_group_id: r.already_current for r in chosen.lifecycle.collect()}
    assert life == {"g": False, "h": False, "i": False, "j": False}


def test_evidence_needs_values_and_accepts_base_names(spark):
    runs = spark.createDataFrame(
        [("full", {"p": "1"}, {"m": 1.0}, {"t": "x"}), ("blank", {"p": ""}, {"m": None}, {})],
        "run_id string, params map<string,string>, metrics map<string,double>, tags map<string,string>")
    paths = spark.createDataFrame([("full", "a/b/manifest.json"), ("full", "x.md"), ("blank", "manifest.json.bak")], "run_id string, path string")
    contract = cfg.EvidenceContract(params=("p",), metrics=("m",), tags=("t",), artifacts=("manifest.json",))
    out = {r.run_id: r for r in selection.check_evidence(runs, paths, contract).collect()}
    assert out["full"].evidence_status == "passed"
    assert (out["blank"].missing_params, out["blank"].missing_metrics, out["blank"].missing_tags, out["blank"].missing_artifacts) == (
        ["p"], ["m"], ["t"], ["manifest.json"])


def test_normalized_runs(spark):
    values = [("r", "tags", "variant_name", "lr"), ("r", "tags", "fair_comparison_group_id", "old"), ("r", "metrics", "f1_macro", "0.5"),
              ("r", "metrics", "combined_accuracy", "NaN"), ("r", "params", "seed", "42"), ("r", "tags", "policy_sha256", None)]
    row = source.normalize_runs(spark.createDataFrame(values, "run_id string, kind string, key string, value string")).first()
    assert (row.variant_name, row.comparison_group_id, row.policy_sha256, row.run_name) == ("lr", "old", "unknown", "unknown")
    assert (row.f1_macro, row.combined_accuracy, row.params) == (0.5, None, {"seed": "42"})


def test_tuning_plan(spark):
    runs = frame(spark, run("a1", "x", 0.0), run("a2", "x", None), run("b1", "y"), run("c1", "z", None), run("c2", "z", None))
    cells = comparison.comparison_cells(runs)
    plan = spark.createDataFrame([(1, "l1", "x", "p"), (2, "l2", "y", "p"), (3, "l3", "z", "q"), (4, "l4", "<GROUP>", "q"), (5, "l5", "none", "q")],
                                 "position bigint, label string, comparison_group_id string, changed_parameter string")
    winners = tuning.group_winners(comparison.complete_runs(runs, cells), "f1_macro")
    rows = tuning.summarize_experiments(plan, comparison.summarize_groups(cells), winners, "f1_macro")
    out = {r.label: r for r in rows.collect()}
    assert (out["l1"].status, out["l1"].winner_run_id, out["l1"].winner_metric_value) == ("valid", "a1", 0.0)
    assert out["l2"].blocked_reason == "comparison contract invalid: at_least_two_runs"
    assert out["l3"].blocked_reason == "missing winner metric: f1_macro"
    assert out["l4"].blocked_reason == "comparison_group_id is a placeholder"
    assert out["l5"].blocked_reason == "no runs found for comparison_group_id"
    status = tuning.plan_status(rows).first()
    assert (status.status, status.first_blocked_label, status.winner_count) == ("blocked", "l2", 1)
    assert tuning.plan_status(rows.filter("status = 'valid'")).first().status == "requires_final_validation"
    assert {r.label for r in tuning.blocked_experiments(rows).collect()} >= {"l2"} and tuning.final_validation(rows).collect() == []
    steps = {r.setting: r.value for r in tuning.final_validation(rows.filter("status = 'valid'")).collect()}
    assert steps == {"recommended_changed_variable": "candidate_config", "baseline_required": "true"}


def test_gate_audit(spark):
    base = {f: "x" for f in (*audit.REPORT_FIELDS, *audit.ARTIFACT_FIELDS, *cfg.CONTENT_HASHES)} | {"status": "passed"}
    names = list(base)
    reports = spark.createDataFrame(
        [("ok", *base.values()), ("bare", *(base | {"git_sha": ""}).values()), ("red", *base.values())],
        "gate_run string, " + ", ".join(f"{n} string" for n in names))
    checks = [("ok", c, "passed", 1) for c in cfg.REQUIRED_GATE_CHECKS] + [("ok", "policy_tests", "failed", 0)]
    checks += [("red", c, "passed", 1) for c in cfg.REQUIRED_GATE_CHECKS] + [("red", "policy_tests", "failed", 2)]
    frame_ = spark.createDataFrame(checks, "gate_run string, check string, status string, position int")
    out = {r.gate_run: (r.evidence_ok, r.first_problem) for r in audit.audit_gates(reports, frame_).collect()}
    assert out == {"ok": (True, None), "bare": (False, "missing_report_fields"), "red": (False, "missing_or_failed_checks")}


def test_metric_table_groups_once(spark):
    """One row in memory for a run, not one for each of its metrics."""
    rows = [("a", "metrics", "m", "1.5"), ("a", "metrics", "m", "2"), ("a", "metrics", "n", "NaN"), ("b", "tags", "m", "7"),
            ("c", "metrics", "other", "1"), (None, "metrics", "n", "3"), ("d", "metrics", "n", "x"), ("d", "metrics", "n", None)]
    values = spark.createDataFrame(rows, "run_id string, kind string, key string, value string")
    table = comparison.metric_table(values, ("m", "n"))
    assert table.columns == ["run_id", "m", "n"]
    assert sorted(map(tuple, table.collect()), key=str) == [("a", 2.0, None), ("d", None, None), (None, None, 3.0)]
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
