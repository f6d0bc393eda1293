"""From a scored line to a decision: classifier, fast path, similarity, fallback, error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.durable import durable
from siftline.functions.text import fill, pick
from siftline.operators import lookup, responses, similarity

MACHINE_CONTEXT = ("recent_deployment", "pod_restart_count", "error_rate", "latency_p95")

# Decision columns beside the id and the raw line, in result order.
DECISION_TYPES = {
    "strategy_used": "string",
    "predicted_action": "string",
    "original_prediction": "string",
    "confidence": "double",
    "risk_level": "string",
    "requires_approval": "boolean",
    "reason": "string",
    "input_text": "string",
    "router_reason": "string",
    "summary": "string",
    "root_cause": "string",
    "missing_context": "array<string>",
    "machine_context": "struct<recent_deployment:string,pod_restart_count:string,"
    "error_rate:string,latency_p95:string,related_logs:array<string>,context_quality:string>",
    "similar_incidents": "array<struct<incident_id:bigint,log:string,known_root_cause:string,"
    "known_action:string,similarity:double,is_similar_enough:boolean>>",
    "error": "string",
}


def machine_context() -> Column:
    """The fixed context of a line for which nothing was collected."""
    fields = [F.lit("unknown").alias(name) for name in MACHINE_CONTEXT]
    return F.struct(
        *fields,
        F.array().cast("array<string>").alias("related_logs"),
        F.lit("low").alias("context_quality"),
    )


def classifier_decision(
    scored: DataFrame, policy: cfg.DecisionPolicy, text: str = "message"
) -> DataFrame:
    """Decision columns from `predicted_label` and the unrounded `probability`.

    Below the minimum confidence the decision is undecided and keeps the model's own
    action in `original_prediction`. The stored confidence is rounded afterwards.
    """
    labels = {k: cfg.DISPLAY_ACTION[a] for k, a in enumerate(cfg.KNOWN_ACTIONS)}
    shown = F.col("_shown")
    unsure = F.col("probability") < policy.min_confidence
    action = F.when(unsure, F.lit(cfg.UNDECIDED)).otherwise(shown)
    low_text = fill(cfg.TEXT_LOW_CONFIDENCE, shown, F.lit(str(policy.min_confidence)))
    return (
        scored.withColumn("_shown", pick("predicted_label", labels))
        .withColumn("predicted_action", action)
        .withColumns(
            {
                "strategy_used": F.lit(cfg.STRATEGY_CLASSIFIER),
                "original_prediction": F.when(unsure, shown),
                "confidence": F.round("probability", 4),
                "risk_level": pick("predicted_action", policy.action_risk),
                "requires_approval": pick("predicted_action", policy.needs_approval),
                "reason": F.when(unsure, low_text).otherwise(fill(cfg.TEXT_PREDICTED, shown)),
                "input_text": F.col(text),
            }
        )
        .drop("_shown")
    )


def is_accepted(policy: cfg.DecisionPolicy) -> Column:
    """Fast path, on the rounded confidence."""
    return (F.col("confidence") >= policy.min_confidence) & (F.col("risk_level") == "low")


def accept(decisions: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Rows the classifier decides alone."""
    return decisions.filter(is_accepted(policy)).withColumn(
        "router_reason", F.lit(cfg.TEXT_ACCEPTED)
    )


def unresolved(decisions: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    return decisions.filter(~is_accepted(policy))


def _disabled_columns() -> dict[str, Column]:
    return {
        "strategy_used": F.lit(cfg.STRATEGY_DISABLED),
        "predicted_action": F.lit(cfg.UNDECIDED),
        "original_prediction": F.lit(None).cast("string"),
        "confidence": F.lit(0.0),
        "risk_level": F.lit("low"),
        "requires_approval": F.lit(True),
        "reason": F.lit(cfg.TEXT_DISABLED),
        "router_reason": F.lit(cfg.TEXT_DISABLED_ROUTE),
    }


def disabled_fallback(decisions: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Decision for unresolved rows when neither similarity nor fallback may be used."""
    return unresolved(decisions, policy).withColumns(_disabled_columns())


def route_without_fallback(decisions: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Fast path or disabled decision in one projection; needs no second input and streams."""
    fast = is_accepted(policy)
    columns = {
        name: F.when(fast, F.col(name) if name in decisions.columns else F.lit(cfg.TEXT_ACCEPTED))
        .otherwise(value)
        for name, value in _disabled_columns().items()
    }
    return decisions.withColumns(columns)


def error_columns(error: Column) -> dict[str, Column]:
    """Decision columns for a line that could not be decided."""
    return {
        "strategy_used": F.lit(cfg.STRATEGY_ERROR),
        "predicted_action": F.lit(cfg.UNDECIDED),
        "confidence": F.lit(0.0),
        "risk_level": F.lit("low"),
        "requires_approval": F.lit(False),
        "reason": fill(cfg.TEXT_FAILED, error),
        "error": error,
    }


def error_decisions(lines: DataFrame, error: str = "parse_error") -> DataFrame:
    """Decisions for the rows with an error."""
    return lines.filter(F.col(error).isNotNull()).withColumns(error_columns(F.col(error)))


def merge_errors(decisions: DataFrame, error: str = "parse_error") -> DataFrame:
    """Replace the decision of broken rows in place and add `status`; streams."""
    broken = F.col(error).isNotNull()
    cleared = {
        name: F.when(~broken, F.col(name))
        for name in ("original_prediction", "input_text", "router_reason")
        if name in decisions.columns
    }
    columns = {
        name: F.when(broken, value).otherwise(F.col(name))
        for name, value in error_columns(F.col(error)).items()
        if name in decisions.columns
    }
    return decisions.withColumns(
        cleared
        | columns
        | {
            "error": F.col(error),
            "status": F.when(broken, F.lit("error")).otherwise(F.lit("ok")),
        }
    )


def fallback_decisions(
    pending: DataFrame,
    answers: DataFrame,
    policy: cfg.DecisionPolicy,
    line_id: str,
    settled: Column | None = None,
    settled_columns: dict[str, Column] | None = None,
) -> DataFrame:
    """Decisions of pending rows from their response; an unusable response is an error.

    pending: line_id, input_text, similar_incidents and more; answers: line_id, raw_text.
    Both sides have one row per line, so the join key is even. Rows for which `settled`
    holds take `settled_columns` instead and their response is not parsed.
    """
    settled = F.lit(False) if settled is None else settled
    chosen = settled_columns or {}
    texts = answers.select(line_id, F.col("raw_text").alias("_answer"))
    kept = {"input_text", "similar_incidents", "original_prediction"}
    base = pending.withColumns({f"_own_{name}": value for name, value in chosen.items()}).withColumn(
        "_settled", settled
    )
    base = base.drop(*DECISION_TYPES.keys() - kept)
    joined = base.join(texts, line_id, "left")
    joined = joined.withColumn("_raw_text", F.when(~F.col("_settled"), F.col("_answer")))
    rows = responses.extract_json(joined, "_raw_text")
    rows = responses.validate_response(rows, policy)

    own = F.col("_settled")
    broken = ~own & F.col("response_error").isNotNull()
    failed = error_columns(F.col("response_error"))
    answered = ~own & ~broken
    answer_columns = {name: F.col(name) for name in failed if name != "error"} | {
        "router_reason": F.lit(cfg.TEXT_FALLBACK_ROUTE)
    }

    def pick_one(name: str) -> Column:
        value = F.when(answered, answer_columns[name])
        if name in failed:
            value = value.when(broken, failed[name])
        return value.when(own, F.col(f"_own_{name}")) if name in chosen else value

    columns = {name: pick_one(name) for name in answer_columns}
    columns |= {n: F.when(answered, F.col(n)) for n in ("summary", "root_cause", "missing_context")}
    columns |= {n: F.when(~broken, F.col(n)) for n in ("similar_incidents", "input_text")}
    columns |= {
        "machine_context": F.when(answered, machine_context()),
        "error": F.when(broken, F.col("response_error")),
        "original_prediction": F.when(own, F.col("original_prediction"))
        if "original_prediction" in pending.columns
        else F.lit(None).cast("string"),
    }
    helpers = ("_settled", "_answer", "_raw_text", "json_text", "parsed", "response_error")
    return rows.withColumns(columns).drop(*helpers, *[f"_own_{name}" for name in chosen])


def conform(decisions: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The same decision columns in the same order for every branch."""
    columns = [
        F.col(name).cast(kind).alias(name)
        if name in decisions.columns
        else F.lit(None).cast(kind).alias(name)
        for name, kind in DECISION_TYPES.items()
    ]
    return decisions.select(*keep, *columns)


def route(
    decisions: DataFrame,
    policy: cfg.DecisionPolicy,
    *,
    line_id: str = "line_id",
    raw: str = "raw_log",
    query_key: str = "query_id",
    query_vectors: DataFrame | None = None,
    memory: DataFrame | None = None,
    answers: DataFrame | None = None,
    error: str = "parse_error",
    exclude_same_id: bool = False,
) -> DataFrame:
    """The whole router. Without memory and answers the fallback counts as disabled.

    Rows that the fast path accepts or that cannot be read are settled in one pass. Only the
    others reach the similarity search, which runs once per distinct query vector, and their
    response is parsed only without a strong match.
    """
    keep = (line_id, raw)
    if memory is None or answers is None or query_vectors is None:
        routed = merge_errors(route_without_fallback(decisions, policy), error)
        return conform(routed, keep).withColumn("status", _status())

    settled = F.col(error).isNotNull() | is_accepted(policy)
    done = decisions.filter(F.coalesce(settled, F.lit(False))).withColumn(
        "router_reason", F.lit(cfg.TEXT_ACCEPTED)
    )
    open_rows = decisions.filter(F.col(error).isNull() & ~is_accepted(policy))

    wanted = open_rows.groupBy(query_key).agg(F.count("*").alias("_lines"))
    vectors = query_vectors.join(
        wanted.select(F.col(query_key).alias("query_id")), "query_id", "left_semi"
    )
    matches = similarity.vote(
        similarity.top_incidents(
            vectors,
            memory,
            threshold=policy.similarity_threshold,
            exclude_same_id=exclude_same_id,
        ),
        policy,
    ).select(F.col("query_id").alias(query_key), "similar_incidents", "strong_and_consistent")
    # Many lines share one text and so one vector: the key may be heavy. The matches are
    # read more than once and are the dear part, so they are kept.
    dim = durable(matches.join(wanted, query_key))
    matched = lookup.attach(
        open_rows.drop("similar_incidents"), dim, query_key, "_lines", spread=line_id
    )
    none = F.array().cast(DECISION_TYPES["similar_incidents"])
    matched = matched.withColumn("similar_incidents", F.coalesce("similar_incidents", none))
    resolved = fallback_decisions(
        matched,
        answers,
        policy,
        line_id,
        settled=F.coalesce("strong_and_consistent", F.lit(False)),
        settled_columns=similarity.similarity_columns(policy),
    )
    routed = conform(merge_errors(done, error), keep).unionByName(conform(resolved, keep))
    return routed.withColumn("status", _status())


def _status() -> Column:
    return F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error"))
