"""Queries over log lines: reading, parsing, scoring, routing, policy, traces, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import inputs
from catalog.oracle_base import FEATURES, case_map, define, policy_sql, query, quoted
from catalog.registry import register
from siftline import config as cfg
from siftline.operators import evaluation, parse, policy, routing, scoring, trace
from siftline.plans import scoring as plans

RULES = cfg.DecisionPolicy()
STAMP = "2026-01-01T00:00:00Z"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return plans.scored_lines(inputs.log_lines(spark, sf), inputs.MODEL)


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = plans.classified_lines(inputs.log_lines(spark, sf), inputs.MODEL, RULES)
    return rows.filter(F.col("parse_error").isNull())


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return plans.decide_lines(inputs.log_lines(spark, sf), inputs.MODEL, RULES)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return parse.training_rows(inputs.log_lines(spark, sf))


# --- reading and parsing -----------------------------------------------------------------


@register(
    "s1_read_log_lines",
    query("SELECT line_id, trim(raw_log) AS raw_log FROM padded WHERE trim(raw_log) <> ''", "padded"),
)
def s1(spark, sf):
    return parse.clean_lines(inputs.padded_lines(spark, sf))


@register(
    "p1_parse_logs",
    query(
        'SELECT line_id, "date", "time", level, service, message, cpu, memory, action, parse_error FROM parsed',
        "parsed",
    ),
)
def p1(spark, sf):
    rows = parse.parse_logs(inputs.log_lines(spark, sf))
    return rows.select("line_id", *parse.EVENT_FIELDS, "parse_error")


@register(
    "p2_clean_numeric",
    query("SELECT line_id, cpu, cpu_missing, memory, memory_missing FROM features", "features"),
)
def p2(spark, sf):
    rows = parse.numeric_readings(parse.parse_logs(inputs.log_lines(spark, sf)))
    return rows.select("line_id", "cpu", "cpu_missing", "memory", "memory_missing")


_HOT = [f for f in cfg.FEATURE_NAMES if "_is_" in f]


@register(
    "p3_one_hot",
    query(f"SELECT line_id, {', '.join(_HOT)} FROM features WHERE parse_error IS NULL", "features"),
)
def p3(spark, sf):
    rows = parse.parse_logs(inputs.log_lines(spark, sf)).filter(F.col("parse_error").isNull())
    return rows.withColumns(parse.indicator_columns()).select("line_id", *_HOT)


@register(
    "p4_keyword_flags",
    query(
        "SELECT line_id, has_timeout, has_latency FROM features WHERE parse_error IS NULL", "features"
    ),
)
def p4(spark, sf):
    rows = parse.parse_logs(inputs.log_lines(spark, sf)).filter(F.col("parse_error").isNull())
    return rows.withColumns(parse.indicator_columns()).select(
        "line_id", "has_timeout", "has_latency"
    )


@register(
    "p5_feature_row",
    query(f"SELECT line_id, {FEATURES} FROM features WHERE parse_error IS NULL", "features"),
)
def p5(spark, sf):
    rows = parse.extract_features(parse.parse_logs(inputs.log_lines(spark, sf)))
    return rows.filter(F.col("parse_error").isNull()).select("line_id", *cfg.FEATURE_NAMES)


@register(
    "p6_feature_map",
    query(
        "\nUNION ALL ".join(
            f"SELECT line_id, '{f}' AS name, {f} AS value FROM features WHERE parse_error IS NULL"
            for f in cfg.FEATURE_NAMES
        ),
        "features",
    ),
)
def p6(spark, sf):
    rows = parse.extract_features(parse.parse_logs(inputs.log_lines(spark, sf)))
    rows = parse.feature_map(rows.filter(F.col("parse_error").isNull()))
    return rows.select("line_id", F.explode("features").alias("name", "value"))


@register(
    "p7_encode_labels",
    query(
        "SELECT line_id, coalesce(label, -1) AS label, label_error FROM features WHERE parse_error IS NULL",
        "features",
    ),
)
def p7(spark, sf):
    rows = parse.encode_labels(parse.parse_logs(inputs.log_lines(spark, sf)))
    return rows.filter(F.col("parse_error").isNull()).select(
        "line_id", F.coalesce("label", F.lit(-1)).alias("label"), "label_error"
    )


@register(
    "p8_usable_rows",
    query(f"SELECT line_id, raw_log, message, label, {FEATURES} FROM usable", "usable"),
)
def p8_usable(spark, sf):
    rows = parse.usable_rows(_rows(spark, sf))
    return rows.select("line_id", "raw_log", "message", "label", *cfg.FEATURE_NAMES)


@register(
    "p8_rejected_rows",
    query(
        "SELECT line_id, raw_log AS line, coalesce(parse_error, label_error) AS error FROM features "
        "WHERE parse_error IS NOT NULL OR label_error IS NOT NULL",
        "features",
    ),
)
def p8_rejected(spark, sf):
    return parse.rejected_rows(_rows(spark, sf)).select("line_id", "line", "error")


@register(
    "p9_display_action",
    query(
        f"SELECT line_id, action, {case_map('action', cfg.DISPLAY_ACTION)} AS display_action FROM parsed "
        "WHERE parse_error IS NULL",
        "parsed",
    ),
)
def p9(spark, sf):
    rows = parse.parse_logs(inputs.log_lines(spark, sf)).filter(F.col("parse_error").isNull())
    return rows.select(
        "line_id", "action", parse.display_action("action").alias("display_action")
    )


@register(
    "p10_action_dimensions",
    query(
        f"SELECT line_id, shown AS display_action, {case_map('shown', cfg.ACTION_RISK)} AS risk_level, "
        f"{case_map('shown', cfg.ACTION_NEEDS_APPROVAL)} AS requires_approval FROM "
        f"(SELECT line_id, {case_map('action', cfg.DISPLAY_ACTION)} AS shown FROM usable)",
        "usable",
    ),
)
def p10(spark, sf):
    rows = parse.usable_rows(_rows(spark, sf)).withColumn(
        "display_action", parse.display_action("action")
    )
    return parse.with_action_dimensions(rows, "display_action", RULES).select(
        "line_id", "display_action", "risk_level", "requires_approval"
    )


# --- scoring and routing -----------------------------------------------------------------


@register(
    "m6b_score_fixed_weights",
    query(
        "SELECT line_id, predicted_label, round(probability, 6) AS probability FROM scored "
        "WHERE parse_error IS NULL",
        "scored",
    ),
)
def m6b(spark, sf):
    return (
        _scored(spark, sf)
        .filter(F.col("parse_error").isNull())
        .select("line_id", "predicted_label", F.round("probability", 6).alias("probability"))
    )


_CLASSIFIED = (
    "line_id, strategy_used, predicted_action, original_prediction, confidence, risk_level, "
    "requires_approval, reason, input_text"
)


@register(
    "r1_classifier_decision",
    query(f"SELECT {_CLASSIFIED} FROM classified WHERE parse_error IS NULL", "classified"),
)
def r1(spark, sf):
    return _classified(spark, sf).select(*_CLASSIFIED.split(", "))


@register(
    "r2_fast_path",
    query(
        f"SELECT {_CLASSIFIED}, '{cfg.TEXT_ACCEPTED}' AS router_reason FROM classified "
        "WHERE parse_error IS NULL AND confidence >= 0.75 AND risk_level = 'low'",
        "classified",
    ),
)
def r2(spark, sf):
    rows = routing.accept(_classified(spark, sf), RULES)
    return rows.select(*_CLASSIFIED.split(", "), "router_reason")


@register(
    "r3_disabled_fallback",
    query(
        f"SELECT {_CLASSIFIED}, router_reason FROM routed_plain WHERE strategy_used = 'llm_disabled'",
        "routed_plain",
    ),
)
def r3(spark, sf):
    rows = routing.disabled_fallback(_classified(spark, sf), RULES)
    return rows.select(*_CLASSIFIED.split(", "), "router_reason")


# Decisions that also hold forbidden actions and high risk, which the classifier never gives.
define(
    "mixed",
    ("classified",),
    "SELECT line_id, strategy_used, CASE WHEN line_id % 29 = 0 THEN 'kubectl_delete' WHEN line_id % 23 = 0 "
    "THEN 'delete_database' ELSE predicted_action END AS predicted_action, confidence, "
    "CASE WHEN line_id % 7 = 0 THEN 'high' ELSE risk_level END AS risk_level, requires_approval, reason "
    "FROM classified WHERE parse_error IS NULL",
)
define("mixed_checked", ("mixed",), policy_sql("mixed"))


def _mixed(spark, sf):
    rows = _classified(spark, sf)
    action = (
        F.when(F.col("line_id") % 29 == 0, "kubectl_delete")
        .when(F.col("line_id") % 23 == 0, "delete_database")
        .otherwise(F.col("predicted_action"))
    )
    risk = F.when(F.col("line_id") % 7 == 0, "high").otherwise(F.col("risk_level"))
    return rows.select(
        "line_id",
        "strategy_used",
        action.alias("predicted_action"),
        "confidence",
        risk.alias("risk_level"),
        "requires_approval",
        "reason",
    )


@register(
    "r12_check_policy",
    query(
        "SELECT line_id, predicted_action, risk_level, confidence, policy_allowed, policy_reason, "
        "requires_approval FROM mixed_checked",
        "mixed_checked",
    ),
)
def r12(spark, sf):
    return policy.check_policy(_mixed(spark, sf), RULES).select(
        "line_id",
        "predicted_action",
        "risk_level",
        "confidence",
        "policy_allowed",
        "policy_reason",
        "requires_approval",
    )


@register(
    "r13_apply_policy",
    query("SELECT line_id, reason, requires_approval, strategy_used FROM mixed_checked", "mixed_checked"),
)
def r13(spark, sf):
    return policy.apply_policy(_mixed(spark, sf), RULES).select(
        "line_id", "reason", "requires_approval", "strategy_used"
    )


_FINAL = (
    "line_id, strategy_used, predicted_action, original_prediction, confidence, risk_level, "
    "requires_approval, reason, router_reason, error, policy_reason"
)


@register(
    "r14_decisions_with_errors",
    query(
        f"SELECT {_FINAL}, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status FROM decided",
        "decided",
    ),
)
def r14(spark, sf):
    return _decided(spark, sf).select(*_FINAL.split(", "), "status")


define(
    "manifests",
    (),
    inputs.MANIFESTS.replace("SHA(", "sha256("),
)
_HASHES = ", ".join(cfg.CONTENT_HASHES)
_TRACE = f"artifact_id, artifact_path, run_id, git_sha, {_HASHES}"
define(
    "traced",
    ("decided", "manifests"),
    f"""SELECT d.*, sha256(m.artifact_id || '|' || CAST(d.line_id AS VARCHAR)) AS decision_id,
      '{STAMP}' AS created_at, {', '.join('m.' + c for c in _TRACE.split(', '))}
    FROM decided d CROSS JOIN (SELECT * FROM manifests ORDER BY artifact_id LIMIT 1) m""",
)


def _traced(spark, sf):
    manifests = inputs.manifests(spark, sf)
    fields = F.struct(*trace.MANIFEST_FIELDS)
    first = manifests.agg(F.min_by(fields, "artifact_id").alias("m")).select("m.*")
    return plans.decide_and_trace(
        inputs.log_lines(spark, sf), inputs.MODEL, RULES, first, created_at=F.lit(STAMP)
    )


@register(
    "r15_attach_trace",
    query(f"SELECT line_id, decision_id, created_at, {_TRACE} FROM traced", "traced"),
)
def r15(spark, sf):
    return _traced(spark, sf).select("line_id", "trace.*")


@register(
    "s2_trace_records",
    query(
        "SELECT decision_id, created_at, raw_log, strategy_used, predicted_action, confidence, "
        "risk_level, requires_approval, reason, artifact_id FROM traced",
        "traced",
    ),
)
def s2(spark, sf):
    return trace.trace_records(_traced(spark, sf)).select(
        "decision_id",
        "created_at",
        "request.raw_log",
        *[
            f"decision.{c}"
            for c in (
                "strategy_used",
                "predicted_action",
                "confidence",
                "risk_level",
                "requires_approval",
                "reason",
            )
        ],
        "decision.trace.artifact_id",
    )


# Decisions broken on purpose in several ways.
_BROKEN = {
    "confidence": "CASE WHEN line_id % 37 = 0 THEN confidence + 1e0 ELSE confidence END",
    "risk_level": "CASE WHEN line_id % 41 = 0 THEN 'urgent' ELSE risk_level END",
    "reason": "CASE WHEN line_id % 43 = 0 THEN NULL ELSE reason END",
    "predicted_action": "CASE WHEN line_id % 47 = 0 THEN NULL ELSE predicted_action END",
}


@register(
    "r16_check_contract",
    query(
        f"""SELECT line_id, concat_ws('; ',
          CASE WHEN predicted_action IS NULL THEN 'predicted_action: missing' END,
          CASE WHEN reason IS NULL THEN 'reason: missing' END,
          CASE WHEN confidence > 1 OR confidence < 0 THEN 'confidence: out of range' END,
          CASE WHEN risk_level NOT IN ({quoted(cfg.RISK_LEVELS)}) THEN 'risk_level: unknown value' END) AS violations,
          NOT (predicted_action IS NULL OR reason IS NULL OR confidence > 1 OR risk_level = 'urgent') AS contract_ok
        FROM (SELECT line_id, {', '.join(f'{v} AS {k}' for k, v in _BROKEN.items())} FROM decided)""",
        "decided",
    ),
)
def r16(spark, sf):
    rows = _decided(spark, sf).withColumns({k: F.expr(v) for k, v in _BROKEN.items()})
    return policy.check_contract(rows).select(
        "line_id", F.array_join("violations", "; ").alias("violations"), "contract_ok"
    )


# --- evaluation --------------------------------------------------------------------------


def _pairs(spark, sf):
    rows = scoring.score(parse.usable_rows(_rows(spark, sf)), inputs.MODEL)
    return rows.withColumnsRenamed({"label": "actual", "predicted_label": "predicted"})


def _document_pairs(spark, sf):
    docs = inputs.table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = inputs.table(spark, sf, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("quality").alias("actual"), (F.col("n_chars") >= 500).cast("int").alias("predicted")
    )


define("pairs", ("scored",), "SELECT *, label AS actual, predicted_label AS predicted FROM scored WHERE parse_error IS NULL AND label_error IS NULL")
define(
    "document_pairs",
    (),
    "SELECT quality AS actual, CAST(n_chars >= 500 AS INTEGER) AS predicted FROM documents JOIN labels USING (doc_id)",
)
QUALITY_LABELS = ("low quality", "high-quality")


def _labels_sql(labels) -> str:
    return "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in enumerate(labels)) + ")"


def _matrix_sql(pairs: str, labels) -> str:
    return f"""SELECT a.id AS actual_id, a.label AS actual, p.id AS predicted_id, p.label AS predicted,
      (SELECT count(*) FROM {pairs} x WHERE x.actual = a.id AND x.predicted = p.id) AS n
    FROM {_labels_sql(labels)} a(id, label) CROSS JOIN {_labels_sql(labels)} p(id, label)"""


define("matrix", ("pairs",), _matrix_sql("pairs", cfg.KNOWN_ACTIONS))
define("document_matrix", ("document_pairs",), _matrix_sql("document_pairs", QUALITY_LABELS))
for _name, _source in (("rates", "matrix"), ("document_rates", "document_matrix")):
    define(
        _name,
        (_source,),
        f"""SELECT l.id AS label_id, l.label, hits, predicted_n, support,
          CASE WHEN predicted_n = 0 THEN 0e0 ELSE hits / predicted_n END AS p,
          CASE WHEN support = 0 THEN 0e0 ELSE hits / support END AS r,
          CASE WHEN predicted_n + support = 0 THEN 0e0 ELSE 2e0 * hits / (predicted_n + support) END AS f
        FROM (SELECT DISTINCT actual_id AS id, actual AS label FROM {_source}) l
        JOIN (SELECT actual_id AS id, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN actual_id = predicted_id THEN n ELSE 0 END) AS BIGINT) AS hits FROM {_source} GROUP BY 1) s USING (id)
        JOIN (SELECT predicted_id AS id, CAST(sum(n) AS BIGINT) AS predicted_n FROM {_source} GROUP BY 1) q USING (id)""",
    )

_METRICS = "SELECT label_id, label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM "


def _matrix(spark, sf):
    return evaluation.confusion_matrix(_pairs(spark, sf), cfg.KNOWN_ACTIONS)


def _document_matrix(spark, sf):
    return evaluation.confusion_matrix(_document_pairs(spark, sf), QUALITY_LABELS)


for _suffix, _build, _m, _r in (
    ("", _matrix, "matrix", "rates"),
    ("_documents", _document_matrix, "document_matrix", "document_rates"),
):
    register(f"a1_confusion_matrix{_suffix}", query(f"SELECT * FROM {_m}", _m))(_build)
    register(f"a2_class_metrics{_suffix}", query(f"{_METRICS}{_r}", _r))(
        lambda spark, sf, build=_build: evaluation.class_metrics(build(spark, sf))
    )
    register(
        f"a3_weakest_class{_suffix}",
        query(
            f"SELECT label AS weakest_class_by_recall, round(r, 4) AS weakest_class_recall FROM {_r} "
            "ORDER BY round(r, 4), label_id LIMIT 1",
            _r,
        ),
    )(
        lambda spark, sf, build=_build: evaluation.weakest_class(
            evaluation.class_metrics(build(spark, sf))
        )
    )
    register(
        f"a5_macro_f1{_suffix}",
        query(
            f"SELECT round(avg(f), 6) AS f1_macro, count(*) AS present_labels FROM {_r} "
            "WHERE support > 0 OR predicted_n > 0",
            _r,
        ),
    )(lambda spark, sf, build=_build: evaluation.macro_f1(build(spark, sf)))
    register(
        f"a11_flat_metrics{_suffix}",
        query(
            "\nUNION ALL ".join(
                f"SELECT 'combined_' || translate(lower(trim(label)), ' -/', '___') || '_{m}' AS metric, "
                f"CAST({e} AS DOUBLE) AS value FROM {_r}"
                for m, e in (
                    ("precision", "round(p, 4)"),
                    ("recall", "round(r, 4)"),
                    ("f1", "round(f, 4)"),
                    ("support", "support"),
                )
            )
            + f"\nUNION ALL SELECT 'combined_weakest_class_recall', min(round(r, 4)) FROM {_r}",
            _r,
        ),
    )(
        lambda spark, sf, build=_build: evaluation.flat_metrics(
            evaluation.class_metrics(build(spark, sf)), "combined"
        )
    )


@register(
    "a4_accuracy",
    query(
        "SELECT round(avg(CASE WHEN actual = predicted THEN 1e0 ELSE 0e0 END), 6) AS accuracy, "
        "count(*) AS row_count FROM pairs",
        "pairs",
    ),
)
def a4(spark, sf):
    return evaluation.accuracy(_pairs(spark, sf))


@register(
    "a6_mistakes",
    query(f"SELECT line_id, message, actual, predicted, {FEATURES} FROM pairs WHERE actual <> predicted", "pairs"),
)
def a6(spark, sf):
    return evaluation.mistakes(_pairs(spark, sf)).select(
        "line_id", "message", "actual", "predicted", *cfg.FEATURE_NAMES
    )


def _quality_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys} count(*) AS decision_count,
      count(*) FILTER (WHERE confidence < 0.75) AS low_confidence_count,
      round(count(*) FILTER (WHERE confidence < 0.75) / count(*), 4) AS low_confidence_rate,
      count(*) FILTER (WHERE requires_approval) AS approval_required_count,
      round(count(*) FILTER (WHERE requires_approval) / count(*), 4) AS approval_required_rate,
      count(*) FILTER (WHERE NOT policy_allowed) AS policy_block_count,
      count(*) FILTER (WHERE strategy_used = 'llm_fallback') AS llm_fallback_count,
      CAST(0 AS BIGINT) AS invalid_decision_schema_count FROM {source}"""


@register(
    "flagship_decision_quality_by_service",
    query(
        _quality_sql("coalesce(service, 'unreadable') AS service,", "decided")
        + " GROUP BY coalesce(service, 'unreadable')",
        "decided",
    ),
)
def flagship(spark, sf):
    rows = _decided(spark, sf).withColumn("service", F.coalesce("service", F.lit("unreadable")))
    return evaluation.decision_quality(rows, RULES.min_confidence, ("service",))


@register("a7_decision_quality", query(_quality_sql("", "mixed_checked"), "mixed_checked"))
def a7(spark, sf):
    rows = policy.check_contract(policy.apply_policy(_mixed(spark, sf), RULES))
    return evaluation.decision_quality(rows, RULES.min_confidence)


_LISTED = (
    "line_id, predicted_action, confidence, risk_level, requires_approval, policy_allowed, policy_reason"
)


def _checked(spark, sf):
    return policy.check_policy(_mixed(spark, sf), RULES).select(*_LISTED.split(", "))


for _name, _where, _call in (
    ("a8_below_threshold", "confidence < 0.75", lambda d: evaluation.decisions_below(d, 0.75)),
    ("a8_needing_approval", "requires_approval", evaluation.decisions_needing_approval),
    ("a8_policy_blocked", "NOT policy_allowed", evaluation.decisions_blocked),
    ("a8_by_confidence", "TRUE", lambda d: evaluation.by_confidence(d, "line_id")),
):
    register(
        _name, query(f"SELECT {_LISTED} FROM mixed_checked WHERE {_where} ORDER BY confidence, line_id", "mixed_checked")
    )(lambda spark, sf, call=_call: call(_checked(spark, sf)))


@register(
    "a9_latency_percentiles",
    """SELECT event_type, count(value) AS sample_count, round(quantile_disc(value, 0.5), 4) AS p50_ms,
      round(quantile_disc(value, 0.95), 4) AS p95_ms, round(max(value), 4) AS max_ms
    FROM events GROUP BY event_type""",
)
def a9(spark, sf):
    return evaluation.latency_summary(inputs.table(spark, sf, "events"), "value", ("event_type",))


@register(
    "a9_latency_percentiles_overall",
    """SELECT count(value) AS sample_count, round(quantile_disc(value, 0.5), 4) AS p50_ms,
      round(quantile_disc(value, 0.95), 4) AS p95_ms, round(max(value), 4) AS max_ms FROM events""",
)
def a9_overall(spark, sf):
    return evaluation.latency_summary(inputs.table(spark, sf, "events"), "value", ())


@register(
    "a10_slowest_first",
    "SELECT event_id, event_type, value AS latency_ms FROM events ORDER BY value DESC, event_id",
)
def a10(spark, sf):
    samples = inputs.table(spark, sf, "events").select(
        "event_id", "event_type", F.col("value").alias("latency_ms")
    )
    return evaluation.slowest_first(samples, "latency_ms", "event_id")
