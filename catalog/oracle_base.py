"""Shared common table expressions of the SQL oracle and a helper to assemble them."""

from __future__ import annotations

from catalog import inputs
from siftline import config as cfg

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTE[name] = (needs, sql)


def query(body: str, *needs: str) -> str:
    """`WITH` list of the needed expressions, in dependency order, before `body`."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTE[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return body
    parts = ",\n".join(f"{name} AS ({CTE[name][1]})" for name in order)
    return f"WITH {parts}\n{body}"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def case_map(col: str, mapping: dict) -> str:
    def lit(v):
        return ("TRUE" if v else "FALSE") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {col} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


FEATURES = ", ".join(cfg.FEATURE_NAMES)

define(
    "log_lines",
    (),
    f"SELECT event_id AS line_id, {inputs.RAW_LOG} AS raw_log FROM (SELECT *, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, json_extract_string(props, '$.k') AS k FROM events)",
)
define("padded", ("log_lines",), f"SELECT line_id, {inputs.PADDED_LOG} AS raw_log FROM log_lines")
define(
    "answers",
    (),
    f"SELECT event_id AS line_id, {inputs.RESPONSE} AS raw_text FROM events",
)
define(
    "tokens",
    ("log_lines",),
    "SELECT *, nullif(list_position(t, 'cpu'), 0) AS pc, nullif(list_position(t, 'memory'), 0) AS pm, "
    "nullif(list_position(t, 'action'), 0) AS pa FROM "
    "(SELECT *, string_split(raw_log, ' ') AS t FROM log_lines)",
)
define(
    "parsed",
    ("tokens",),
    """SELECT line_id, raw_log,
      CASE WHEN len(t) >= 4 THEN t[1] END AS "date", CASE WHEN len(t) >= 4 THEN t[2] END AS "time",
      CASE WHEN len(t) >= 4 THEN upper(t[3]) END AS level,
      CASE WHEN len(t) >= 4 THEN lower(t[4]) END AS service,
      CASE WHEN len(t) >= 4 THEN lower(array_to_string(t[5:coalesce(least(pc, pm, pa) - 1, len(t))], ' ')) END AS message,
      CASE WHEN len(t) >= 4 THEN t[pc + 1] END AS cpu, CASE WHEN len(t) >= 4 THEN t[pm + 1] END AS memory,
      CASE WHEN len(t) >= 4 THEN t[pa + 1] END AS action,
      CASE WHEN len(t) < 4 THEN 'too few tokens' END AS parse_error
    FROM tokens""",
)


def _number(col: str) -> str:
    return f"CASE WHEN regexp_full_match({col}, '[+-]?[0-9]+') THEN TRY_CAST({col} AS BIGINT) END"


_FLAGS = ", ".join(
    [f"CAST(service = '{s}' AS INTEGER) AS service_is_{s}" for s in cfg.KNOWN_SERVICES]
    + [f"CAST(level = '{v}' AS INTEGER) AS level_is_{v}" for v in cfg.KNOWN_LEVELS]
    + [f"CAST(contains(message, '{w}') AS INTEGER) AS has_{w}" for w in ("timeout", "latency")]
)
_LABEL = case_map("action", {a: k for k, a in enumerate(cfg.KNOWN_ACTIONS)})
define(
    "features",
    ("parsed",),
    f"""SELECT line_id, raw_log, service, message, level, action, parse_error, {_LABEL} AS label,
      CASE WHEN parse_error IS NULL AND action IS NULL THEN 'missing label: action'
           WHEN parse_error IS NULL AND {_LABEL} IS NULL THEN 'unknown action: ''' || action || '''' END AS label_error,
      CAST(CASE WHEN nc BETWEEN 0 AND 100 THEN nc ELSE -1 END AS INTEGER) AS cpu,
      CASE WHEN nc BETWEEN 0 AND 100 THEN 0 ELSE 1 END AS cpu_missing,
      CAST(CASE WHEN nm BETWEEN 0 AND 100 THEN nm ELSE -1 END AS INTEGER) AS memory,
      CASE WHEN nm BETWEEN 0 AND 100 THEN 0 ELSE 1 END AS memory_missing, {_FLAGS}
    FROM (SELECT *, {_number('cpu')} AS nc, {_number('memory')} AS nm FROM parsed)""",
)
define("usable", ("features",), "SELECT * FROM features WHERE parse_error IS NULL AND label_error IS NULL")


def _margins() -> str:
    out = []
    for k, (intercept, row) in enumerate(zip(inputs.MODEL.intercepts, inputs.MODEL.weights)):
        terms = " + ".join(f"({w}e0) * {f}" for f, w in zip(cfg.FEATURE_NAMES, row) if w)
        out.append(f"({intercept}e0) + {terms} AS m{k}")
    return ", ".join(out)


define(
    "scored",
    ("features",),
    f"""SELECT *, CASE WHEN m0 = top THEN 0 WHEN m1 = top THEN 1 WHEN m2 = top THEN 2 END AS predicted_label,
      1e0 / (exp(m0 - top) + exp(m1 - top) + exp(m2 - top)) AS probability
    FROM (SELECT *, greatest(m0, m1, m2) AS top FROM (SELECT *, {_margins()} FROM features))""",
)
_RISK = {k: v for k, v in cfg.ACTION_RISK.items()}
define(
    "classified",
    ("scored",),
    f"""SELECT *, {case_map('predicted_action', _RISK)} AS risk_level,
      {case_map('predicted_action', cfg.ACTION_NEEDS_APPROVAL)} AS requires_approval
    FROM (SELECT *, 'manual_features_plus_tfidf' AS strategy_used,
      CASE WHEN probability < 0.75 THEN 'needs_more_context' ELSE shown END AS predicted_action,
      CASE WHEN probability < 0.75 THEN shown END AS original_prediction,
      round(probability, 4) AS confidence, message AS input_text,
      CASE WHEN probability < 0.75 THEN 'Low confidence prediction. Model suggested ' || shown || ', but confidence is below 0.75.'
           ELSE 'Predicted ' || shown || ' based on combined manual features and TF-IDF text signals.' END AS reason
    FROM (SELECT *, CASE predicted_label WHEN 0 THEN 'open_ticket' WHEN 1 THEN 'ignore' WHEN 2 THEN 'suggest_scale_up' END AS shown
      FROM scored))""",
)
_DECISION = "line_id, raw_log, service, message, strategy_used, predicted_action, original_prediction, confidence, risk_level, requires_approval, reason, input_text"
define(
    "routed_plain",
    ("classified",),
    f"""SELECT {_DECISION}, '{cfg.TEXT_ACCEPTED}' AS router_reason, CAST(NULL AS VARCHAR) AS error FROM classified
      WHERE parse_error IS NULL AND confidence >= 0.75 AND risk_level = 'low'
    UNION ALL
    SELECT line_id, raw_log, service, message, 'llm_disabled', 'needs_more_context', NULL, 0e0, 'low', TRUE, '{cfg.TEXT_DISABLED}',
      input_text, '{cfg.TEXT_DISABLED_ROUTE}', NULL FROM classified
      WHERE parse_error IS NULL AND NOT (confidence >= 0.75 AND risk_level = 'low')
    UNION ALL
    SELECT line_id, raw_log, service, message, 'error_handler', 'needs_more_context', NULL, 0e0, 'low', FALSE,
      'Prediction failed for this log: ' || parse_error, NULL, NULL, parse_error FROM classified WHERE parse_error IS NOT NULL""",
)


def policy_sql(source: str) -> str:
    """Policy check over a relation with decision columns."""
    forbidden = f"predicted_action IN ({quoted(cfg.FORBIDDEN_ACTIONS)})"
    low = "'Confidence ' || printf('%.2f', confidence) || ' is below approval threshold 0.70.'"
    return f"""SELECT * REPLACE ((requires_approval OR policy_reason <> '{cfg.TEXT_POLICY_ALLOWED}') AS requires_approval,
        CASE WHEN policy_reason <> '{cfg.TEXT_POLICY_ALLOWED}' THEN reason || ' [' || policy_reason || ']' ELSE reason END AS reason),
        reason AS own_reason
      FROM (SELECT *, NOT ({forbidden}) AS policy_allowed,
        CASE WHEN {forbidden} THEN 'Action ''' || predicted_action || ''' is forbidden by policy.'
             WHEN risk_level = 'high' AND confidence < 0.7 THEN '{cfg.TEXT_POLICY_HIGH_RISK} ' || {low}
             WHEN risk_level = 'high' THEN '{cfg.TEXT_POLICY_HIGH_RISK}'
             WHEN confidence < 0.7 THEN {low}
             ELSE '{cfg.TEXT_POLICY_ALLOWED}' END AS policy_reason FROM {source})"""


define("decided", ("routed_plain",), policy_sql("routed_plain"))
