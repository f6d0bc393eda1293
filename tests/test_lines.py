"""Parsing, features, labels, scoring, routing and policy on hand-made lines."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalog.inputs import MODEL
from siftline import config as cfg
from siftline.functions.numeric import two_decimals
from siftline.operators import evaluation, parse, policy, responses, routing, trace
from siftline.plans import scoring as plans

RULES = cfg.DecisionPolicy()


def frame(spark, *lines):
    rows = [(i, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "line_id bigint, raw_log string")


def parsed(spark, line):
    return parse.parse_logs(frame(spark, line)).first().asDict()


def test_parse_full_line(spark):
    row = parsed(spark, "2026-05-03 09:12:11 error Payments DB Timeout now cpu 92 memory 81 action open_ticket")
    assert (row["date"], row["time"], row["level"], row["service"]) == ("2026-05-03", "09:12:11", "ERROR", "payments")
    assert row["message"] == "db timeout now"
    assert (row["cpu"], row["memory"], row["action"], row["parse_error"]) == ("92", "81", "open_ticket", None)


@pytest.mark.parametrize(
    ("line", "message", "cpu", "memory", "action"),
    [
        ("d t INFO web all fine", "all fine", None, None, None),
        ("d t INFO web fine cpu", "fine", None, None, None),
        ("d t INFO cpu lost words memory 5", "", "lost", "5", None),
        ("d t INFO web a cpu 1 cpu 2", "a", "1", None, None),
        ("d t INFO web a CPU 1", "a cpu 1", None, None, None),
        ("  d\tt INFO web   a\x1cb  ", "a b", None, None, None),
        ("d t INFO web", "", None, None, None),
        ("d t INFO web a action Restart cpu 3", "a", "3", None, "Restart"),
    ],
)
def test_parse_edges(spark, line, message, cpu, memory, action):
    row = parsed(spark, line)
    assert (row["message"], row["cpu"], row["memory"], row["action"]) == (message, cpu, memory, action)


def test_short_line_is_rejected_everywhere(spark):
    row = parsed(spark, "2026-05-03 09:12:11 ERROR")
    assert row["parse_error"] == "too few tokens" and row["level"] is None
    rows = parse.training_rows(frame(spark, "a b c", "a b INFO web x action ignore", "a b INFO web x", "a b INFO web x action go"))
    assert parse.usable_rows(rows).count() == 1
    errors = {r.line_id: r.error for r in parse.rejected_rows(rows).collect()}
    assert errors == {0: "too few tokens", 2: "missing label: action", 3: "unknown action: 'go'"}


def test_clean_lines(spark):
    rows = parse.clean_lines(frame(spark, "  a b ", "   ", "", "\t x ")).collect()
    assert [r.raw_log for r in rows] == ["a b", "x"]


@pytest.mark.parametrize(
    ("text", "value", "missing"),
    [("92", 92, 0), ("0", 0, 0), ("100", 100, 0), ("101", -1, 1), ("-1", -1, 1), ("+7", 7, 0),
     ("92%", -1, 1), ("9.5", -1, 1), ("1_0", -1, 1), ("99999999999999999999", -1, 1)],
)
def test_numeric_readings(spark, text, value, missing):
    row = parse.extract_features(parse.parse_logs(frame(spark, f"d t INFO web m cpu {text}"))).first()
    assert (row.cpu, row.cpu_missing, row.memory, row.memory_missing) == (value, missing, -1, 1)


def test_feature_row_and_map(spark):
    rows = parse.extract_features(parse.parse_logs(frame(spark, "d t WARN storage High Latency timeouts cpu 5 memory 6")))
    row = parse.feature_map(rows).first()
    assert [row[f] for f in cfg.FEATURE_NAMES] == [5, 0, 6, 0, 0, 0, 0, 0, 0, 0, 1, 1]
    assert row.features["has_latency"] == 1 and len(row.features) == 12


def test_two_decimals_like_c(spark):
    texts = spark.range(0, 10001).select("id", two_decimals(F.round(F.col("id") / 10000, 4)).alias("t"))
    wrong = [(r.id, r.t) for r in texts.collect() if r.t != f"{r.id / 10000:.2f}"]
    assert wrong == []


def classified(spark, *pairs):
    rows = [(i, label, p, "text") for i, (label, p) in enumerate(pairs)]
    return routing.classifier_decision(
        spark.createDataFrame(rows, "line_id bigint, predicted_label int, probability double, message string"), RULES
    )


def test_threshold_uses_unrounded_then_rounded_confidence(spark):
    rows = classified(spark, (0, 0.74996), (0, 0.75), (2, 0.99), (1, 0.5)).orderBy("line_id").collect()
    assert [r.predicted_action for r in rows] == ["needs_more_context", "open_ticket", "suggest_scale_up", "needs_more_context"]
    assert [r.original_prediction for r in rows] == ["open_ticket", None, None, "ignore"]
    assert rows[0].confidence == 0.75 and rows[2].risk_level == "medium" and rows[2].requires_approval
    routed = routing.route_without_fallback(classified(spark, (0, 0.74996), (0, 0.75), (2, 0.99), (1, 0.5)), RULES)
    rows = routed.orderBy("line_id").collect()
    assert [r.strategy_used for r in rows] == [cfg.STRATEGY_CLASSIFIER] * 2 + [cfg.STRATEGY_DISABLED] * 2
    assert rows[2].confidence == 0.0 and rows[2].requires_approval and rows[2].reason == cfg.TEXT_DISABLED


def decision(**changes):
    base = dict(strategy_used="test", predicted_action="open_ticket", confidence=0.95, risk_level="low",
                requires_approval=False, reason="because")
    return Row(**(base | changes))


def test_policy_rules(spark):
    rows = spark.createDataFrame([
        decision(predicted_action="delete_database", risk_level="high", confidence=0.1),
        decision(risk_level="high"),
        decision(confidence=0.42),
        decision(risk_level="high", confidence=0.42),
        decision(),
        decision(confidence=0.7),
    ])
    out = policy.apply_policy(rows, RULES).collect()
    assert [r.policy_allowed for r in out] == [False, True, True, True, True, True]
    assert [r.requires_approval for r in out] == [True, True, True, True, False, False]
    assert out[0].policy_reason == "Action 'delete_database' is forbidden by policy."
    assert out[3].policy_reason == (
        "High-risk decision requires human approval. Confidence 0.42 is below approval threshold 0.70.")
    assert out[2].reason == "because [Confidence 0.42 is below approval threshold 0.70.]"
    assert out[4].reason == "because"


def test_contract_violations(spark):
    rows = spark.createDataFrame([decision(), decision(confidence=1.2), decision(risk_level="urgent"), decision(confidence=float("nan"))])
    out = [r.violations for r in policy.check_contract(rows).collect()]
    assert out == [[], ["confidence: out of range"], ["risk_level: unknown value"], ["confidence: out of range"]]
    extra = rows.withColumn("surprise", F.lit(1))
    assert "surprise: unknown field" in policy.check_contract(extra, policy.REQUIRED_FIELDS).first().violations


@pytest.mark.parametrize(
    ("text", "action", "confidence", "error"),
    [
        ('x {"recommended_action": "ignore", "confidence": 0.9} y', "ignore", 0.9, None),
        ('{"recommended_action": "ignore", "confidence": 0.74999}', "needs_more_context", 0.75, None),
        ('{"recommended_action": "kubectl_delete", "confidence": 0.95}', "needs_more_context", 0.95, None),
        ('{"recommended_action": "ignore", "confidence": 1.7}', "ignore", 1.0, None),
        ('{"recommended_action": "ignore", "confidence": -3}', "needs_more_context", 0.0, None),
        ('{"recommended_action": "ignore", "confidence": "0.9"}', "needs_more_context", 0.0, None),
        ('{"recommended_action": "ignore", "confidence": 1}', "ignore", 1.0, None),
        ("{}", "needs_more_context", 0.0, None),
        ("no object", None, None, responses.NO_OBJECT),
        ('{"a": 1', None, None, responses.NO_OBJECT),
        ('} {', None, None, responses.MALFORMED),
        ('{"a": }', None, None, responses.MALFORMED),
    ],
)
def test_responses(spark, text, action, confidence, error):
    rows = spark.createDataFrame([(1, text)], "line_id bigint, raw_text string")
    good, bad = responses.response_decisions(rows, RULES)
    if error:
        assert good.count() == 0 and bad.first().response_error == error
    else:
        row = good.first()
        assert (row.predicted_action, row.confidence) == (action, confidence)
        assert row.reason == cfg.TEXT_FALLBACK_REASON and row.summary == "" and row.missing_context == []


def test_decisions_do_not_depend_on_partitioning(spark):
    lines = spark.range(300).select(
        F.col("id").alias("line_id"),
        F.concat(F.lit("d t ERROR web db timeout cpu "), (F.col("id") % 120).cast("string")).alias("raw_log"),
    )
    results = [
        sorted(map(str, plans.decide_lines(lines.repartition(n), MODEL, RULES).select("line_id", "confidence", "reason").collect()))
        for n in (1, 7)
    ]
    assert results[0] == results[1]


def manifest(spark, **changes):
    values = {f: f for f in trace.MANIFEST_FIELDS} | changes
    return spark.createDataFrame([Row(**values)])


def test_trace_is_stable_and_complete(spark):
    lines = frame(spark, "d t INFO web ok", "short")
    ids = [
        sorted(r.decision_id for r in trace.trace_records(plans.decide_and_trace(lines.repartition(n), MODEL, RULES, manifest(spark))).collect())
        for n in (1, 3)
    ]
    assert ids[0] == ids[1] and len(set(ids[0])) == 2
    row = plans.decide_and_trace(lines, MODEL, RULES, manifest(spark)).filter("status = 'error'").first()
    assert row.strategy_used == "error_handler" and row.trace.model_sha256 == "model_sha256"
    assert row.requires_approval and row.reason.startswith("Prediction failed for this log: too few tokens [")
    assert len(row.trace.created_at) == 20 and row.trace.created_at.endswith("Z")


def test_trace_audit(spark):
    good = {"decision_id": "1", **{f: f for f in trace.MANIFEST_FIELDS}}
    rows = spark.createDataFrame([
        Row(**good), Row(**(good | {"decision_id": "2", "config_sha256": "x"})), Row(**(good | {"decision_id": "3", "artifact_id": "gone"})),
    ])
    out = {r.decision_id: (r.audit_status, r.mismatches) for r in trace.audit_traces(rows, manifest(spark)).collect()}
    assert out == {"1": ("ok", []), "2": ("mismatch", ["config_sha256"]), "3": ("manifest_missing", [])}


def test_confusion_and_rates(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "actual int, predicted int")
    matrix = evaluation.confusion_matrix(pairs, ("a b", "c", "d/e"))
    assert matrix.count() == 9 and matrix.agg(F.sum("n")).first()[0] == 4
    rates = {r.label: r for r in evaluation.class_metrics(matrix).collect()}
    assert (rates["a b"].precision, rates["a b"].recall, rates["a b"].f1) == (1.0, 0.5, 0.6667)
    assert (rates["d/e"].recall, rates["d/e"].support) == (0.0, 0)
    weakest = evaluation.weakest_class(evaluation.class_metrics(matrix)).first()
    assert (weakest.weakest_class_by_recall, weakest.weakest_class_recall) == ("d/e", 0.0)
    f1 = evaluation.macro_f1(matrix).first()
    assert f1.present_labels == 2 and f1.f1_macro == round((2 / 3 + 0.8) / 2, 6)
    names = {r.metric for r in evaluation.flat_metrics(evaluation.class_metrics(matrix), "combined").collect()}
    assert {"combined_a_b_recall", "combined_d_e_support", "combined_weakest_class_recall"} <= names


def test_quality_of_no_rows(spark):
    empty = spark.createDataFrame([], "confidence double, requires_approval boolean, policy_allowed boolean, strategy_used string")
    row = evaluation.decision_quality(empty, 0.75).first()
    assert (row.decision_count, row.low_confidence_rate, row.approval_required_rate) == (0, 0.0, 0.0)


def nearest_rank(values, q):
    ordered = sorted(values)
    return ordered[max(0, min(math.ceil(q * len(ordered)) - 1, len(ordered) - 1))]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 20, 21, 100, 1000])
def test_percentiles_against_brute_force(spark, n):
    values = [((i * 7919) % 613) / 7 - 20 for i in range(n)] + [0.0] * (n // 2)
    data = spark.createDataFrame([("g", v) for v in values] + [("one", 5.0)], "g string, v double").repartition(5)
    rows = {r.g: r for r in evaluation.latency_summary(data, "v", ("g",)).collect()}
    assert rows["g"].p50_ms == round(nearest_rank(values, 0.5), 4)
    assert rows["g"].p95_ms == round(nearest_rank(values, 0.95), 4)
    assert rows["g"].max_ms == round(max(values), 4) and rows["one"].p95_ms == 5.0


def test_percentiles_of_no_rows(spark):
    row = evaluation.latency_summary(spark.createDataFrame([], "v double"), "v", ()).first()
    assert (row.sample_count, row.p50_ms, row.p95_ms, row.max_ms) == (0, 0.0, 0.0, 0.0)
