"""Queries over embeddings and model responses, and the whole router."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import inputs
from catalog.oracle_base import case_map, define, policy_sql, query, quoted
from catalog.registry import register
from siftline import config as cfg
from siftline.operators import evaluation, policy, responses, routing, similarity
from siftline.plans import scoring as plans

RULES = replace(cfg.DecisionPolicy(), similarity_threshold=inputs.SIMILARITY_THRESHOLD)
_T = f"{inputs.SIMILARITY_THRESHOLD}e0"

define("vectors", (), "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")
define(
    "cosines",
    ("vectors",),
    f"""SELECT q.vec_id AS query_id, m.vec_id AS incident_id, {inputs.KNOWN_ACTION.replace('label', 'm.label')} AS known_action,
      'incident ' || CAST(m.vec_id AS VARCHAR) AS log, 'cause ' || CAST(m.label AS VARCHAR) AS known_root_cause,
      list_dot_product(q.e, m.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(m.e, m.e))) AS c
    FROM vectors q JOIN vectors m ON q.vec_id <> m.vec_id""",
)
define(
    "top3",
    ("cosines",),
    f"""SELECT query_id, incident_id, log, known_root_cause, known_action, round(c, 4) AS similarity, c >= {_T} AS is_similar_enough, rank
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 4) DESC, incident_id) AS rank FROM cosines)
    WHERE rank <= 3""",
)
define(
    "votes",
    ("top3",),
    f"""SELECT query_id, top_similarity, agreement, top_similarity >= {_T} AS is_strong, agreement >= 2 AS is_consistent,
      top_similarity >= {_T} AND agreement >= 2 AS strong_and_consistent, top_action
    FROM (SELECT query_id, max(similarity) AS top_similarity, min_by(known_action, rank) AS top_action FROM top3 GROUP BY 1)
    JOIN (SELECT query_id, max(n) AS agreement FROM (SELECT query_id, known_action, CAST(count(*) AS INTEGER) AS n FROM top3 GROUP BY ALL) GROUP BY 1)
    USING (query_id)""",
)
define(
    "similar_decisions",
    ("votes",),
    f"""SELECT query_id, 'embedding_similarity' AS strategy_used, top_action AS predicted_action, top_similarity AS confidence,
      {case_map('top_action', cfg.ACTION_RISK)} AS risk_level, {case_map('top_action', cfg.ACTION_NEEDS_APPROVAL)} AS requires_approval,
      '{cfg.TEXT_SIMILAR}' AS reason,
      CASE WHEN top_similarity >= 0.95 THEN '{cfg.TEXT_SIMILAR_EXACT}' ELSE '{cfg.TEXT_SIMILAR_AGREED}' END AS router_reason
    FROM votes WHERE strong_and_consistent""",
)
define(
    "extracted",
    ("answers",),
    f"""SELECT *, CASE WHEN NOT (contains(raw_text, '{{') AND contains(raw_text, '}}')) THEN '{responses.NO_OBJECT}'
      WHEN json_text IS NULL OR NOT json_valid(json_text) THEN '{responses.MALFORMED}' END AS response_error
    FROM (SELECT line_id, raw_text, nullif(regexp_extract(raw_text, '(?s)\\{{.*\\}}'), '') AS json_text FROM answers)""",
)


def _json_text(field: str, default: str) -> str:
    return (
        f"CASE coalesce(json_type(json_text, '$.{field}'), 'ABSENT') WHEN 'ABSENT' THEN '{default}' "
        f"WHEN 'NULL' THEN 'None' ELSE json_extract_string(json_text, '$.{field}') END AS {field}"
    )


define(
    "validated",
    ("extracted",),
    f"""SELECT line_id, 'llm_fallback' AS strategy_used, predicted_action, round(conf, 4) AS confidence,
      {case_map('predicted_action', cfg.ACTION_RISK)} AS risk_level,
      {case_map('predicted_action', cfg.ACTION_NEEDS_APPROVAL)} AS requires_approval, summary, root_cause, reason, missing_context
    FROM (SELECT *, CASE WHEN act IN ({quoted(cfg.ALLOWED_ACTIONS)}) AND conf >= 0.75 THEN act ELSE 'needs_more_context' END AS predicted_action
    FROM (SELECT line_id, json_extract_string(json_text, '$.recommended_action') AS act,
      greatest(0e0, least(1e0, CASE WHEN json_type(json_text, '$.confidence') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
        THEN CAST(json_extract_string(json_text, '$.confidence') AS DOUBLE) ELSE 0e0 END)) AS conf,
      {_json_text('summary', '')}, {_json_text('root_cause', '')}, {_json_text('reason', cfg.TEXT_FALLBACK_REASON)},
      coalesce(array_to_string(CAST(json_extract(json_text, '$.missing_context') AS VARCHAR[]), ','), '') AS missing_context
    FROM extracted WHERE response_error IS NULL))""",
)


def _matches(spark, sf):
    return similarity.top_incidents(
        inputs.query_vectors(spark, sf),
        inputs.incident_memory(spark, sf),
        threshold=RULES.similarity_threshold,
        exclude_same_id=True,
    )


@register(
    "r4_cosine_similarity",
    query(
        """SELECT a.vec_id, b.vec_id AS next_id, round(list_dot_product(a.e, b.e) /
          (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS similarity
        FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1""",
        "vectors",
    ),
)
def r4(spark, sf):
    left = inputs.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("vec_id") + 1).alias("next_id"), F.col("embedding").alias("a")
    )
    right = inputs.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("next_id"), F.col("embedding").alias("b")
    )
    value = similarity.cosine(F.col("a"), F.col("b"))
    return left.join(right, "next_id").select(
        "vec_id", "next_id", F.round(value, 6).alias("similarity")
    )


@register(
    "r5_top_incidents",
    query(
        "SELECT query_id, CAST(rank AS INTEGER) AS rank, incident_id, log, known_root_cause, known_action, similarity, is_similar_enough FROM top3",
        "top3",
    ),
)
def r5(spark, sf):
    rows = _matches(spark, sf).select(
        "query_id", F.posexplode("similar_incidents").alias("pos", "match")
    )
    return rows.select("query_id", (F.col("pos") + 1).alias("rank"), "match.*")


@register(
    "r6_vote",
    query(
        "SELECT query_id, top_similarity, agreement, is_strong, is_consistent, strong_and_consistent FROM votes",
        "votes",
    ),
)
def r6(spark, sf):
    return similarity.vote(_matches(spark, sf), RULES).drop("similar_incidents")


_SIMILAR = "query_id, strategy_used, predicted_action, confidence, risk_level, requires_approval, reason, router_reason"


@register("r7_similarity_decision", query(f"SELECT {_SIMILAR} FROM similar_decisions", "similar_decisions"))
def r7(spark, sf):
    return similarity.similarity_decision(_matches(spark, sf), RULES).select(*_SIMILAR.split(", "))


@register(
    "r8_extract_json",
    query("SELECT line_id, json_text, response_error FROM extracted", "extracted"),
)
def r8(spark, sf):
    return responses.extract_json(inputs.answers(spark, sf)).select(
        "line_id", "json_text", "response_error"
    )


@register("r9_validate_response", query("SELECT * FROM validated", "validated"))
def r9(spark, sf):
    good, _ = responses.response_decisions(inputs.answers(spark, sf), RULES)
    return good.drop("raw_text").withColumn("missing_context", F.array_join("missing_context", ","))


define(
    "open_lines",
    ("classified",),
    "SELECT *, line_id % (SELECT count(*) FROM embeddings) AS query_id FROM classified "
    "WHERE parse_error IS NULL AND NOT (confidence >= 0.75 AND risk_level = 'low')",
)
define(
    "top_lists",
    ("top3",),
    "SELECT query_id, string_agg(CAST(incident_id AS VARCHAR), ',' ORDER BY rank) AS incidents FROM top3 GROUP BY query_id",
)
define(
    "pending",
    ("open_lines", "votes", "top_lists"),
    "SELECT o.*, incidents FROM open_lines o JOIN votes v USING (query_id) JOIN top_lists USING (query_id) WHERE NOT v.strong_and_consistent",
)
_ROUTED = (
    "line_id, strategy_used, predicted_action, original_prediction, confidence, risk_level, "
    "requires_approval, reason, input_text, router_reason, summary, root_cause, missing_context, incidents, context_quality, error"
)
define(
    "fallback",
    ("pending", "validated", "extracted"),
    f"""SELECT p.line_id, v.strategy_used, v.predicted_action, CAST(NULL AS VARCHAR) AS original_prediction, v.confidence, v.risk_level,
      v.requires_approval, v.reason, p.input_text, '{cfg.TEXT_FALLBACK_ROUTE}' AS router_reason, v.summary, v.root_cause,
      v.missing_context, p.incidents, 'low' AS context_quality, CAST(NULL AS VARCHAR) AS error
    FROM pending p JOIN validated v USING (line_id)
    UNION ALL
    SELECT line_id, 'error_handler', 'needs_more_context', NULL, 0e0, 'low', FALSE, 'Prediction failed for this log: ' || response_error,
      NULL, NULL, NULL, NULL, NULL, NULL, NULL, response_error FROM pending JOIN extracted USING (line_id) WHERE response_error IS NOT NULL""",
)
define(
    "routed",
    ("classified", "open_lines", "similar_decisions", "fallback", "top_lists"),
    f"""SELECT line_id, strategy_used, predicted_action, original_prediction, confidence, risk_level, requires_approval, reason, input_text,
      '{cfg.TEXT_ACCEPTED}' AS router_reason, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS root_cause,
      CAST(NULL AS VARCHAR) AS missing_context, CAST(NULL AS VARCHAR) AS incidents, CAST(NULL AS VARCHAR) AS context_quality, CAST(NULL AS VARCHAR) AS error
    FROM classified WHERE parse_error IS NULL AND confidence >= 0.75 AND risk_level = 'low'
    UNION ALL
    SELECT o.line_id, s.strategy_used, s.predicted_action, o.original_prediction, s.confidence, s.risk_level, s.requires_approval,
      s.reason, o.input_text, s.router_reason, NULL, NULL, NULL, incidents, NULL, NULL
    FROM open_lines o JOIN similar_decisions s USING (query_id) JOIN top_lists USING (query_id)
    UNION ALL SELECT * FROM fallback
    UNION ALL
    SELECT line_id, 'error_handler', 'needs_more_context', NULL, 0e0, 'low', FALSE, 'Prediction failed for this log: ' || parse_error,
      NULL, NULL, NULL, NULL, NULL, NULL, NULL, parse_error FROM classified WHERE parse_error IS NOT NULL""",
)
define("routed_checked", ("routed",), policy_sql("routed"))


def _routed(spark, sf):
    lines = plans.classified_lines(inputs.log_lines(spark, sf), inputs.MODEL, RULES)
    return routing.route(
        inputs.with_query_key(lines, spark, sf),
        RULES,
        query_vectors=inputs.query_vectors(spark, sf),
        memory=inputs.incident_memory(spark, sf),
        answers=inputs.answers(spark, sf),
        exclude_same_id=True,
    )


def _flat(decisions):
    incidents = F.transform("similar_incidents", lambda m: m.incident_id.cast("string"))
    return decisions.withColumns(
        {
            "incidents": F.array_join(incidents, ","),
            "missing_context": F.array_join("missing_context", ","),
            "context_quality": F.col("machine_context.context_quality"),
        }
    )


@register("r10_fallback_merge", query(f"SELECT {_ROUTED} FROM fallback", "fallback"))
def r10(spark, sf):
    rows = plans.classified_lines(inputs.log_lines(spark, sf), inputs.MODEL, RULES)
    rows = inputs.with_query_key(rows.filter(F.col("parse_error").isNull()), spark, sf)
    votes = similarity.vote(_matches(spark, sf), RULES)
    pending = routing.unresolved(rows, RULES).join(votes.filter(~F.col("strong_and_consistent")), "query_id")
    merged = routing.fallback_decisions(pending, inputs.answers(spark, sf), RULES, "line_id")
    return _flat(routing.conform(merged, ("line_id",))).select(*_ROUTED.split(", "))


@register("r11_route_cascade", query(f"SELECT {_ROUTED} FROM routed", "routed"))
def r11(spark, sf):
    return _flat(_routed(spark, sf)).select(*_ROUTED.split(", "))


@register(
    "r11_routed_quality_by_strategy",
    query(
        """SELECT strategy_used, count(*) AS decision_count,
          count(*) FILTER (WHERE confidence < 0.75) AS low_confidence_count,
          count(*) FILTER (WHERE requires_approval) AS approval_required_count
        FROM routed_checked GROUP BY strategy_used""",
        "routed_checked",
    ),
)
def r11_quality(spark, sf):
    checked = policy.apply_policy(_routed(spark, sf), RULES)
    return evaluation.decision_quality(checked, RULES.min_confidence, ("strategy_used",)).select(
        "strategy_used", "decision_count", "low_confidence_count", "approval_required_count"
    )
