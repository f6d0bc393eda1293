"""Model responses (free text around a JSON object) to validated decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.once import computed_once
from siftline.functions.text import pick

NO_OBJECT = "response does not contain a JSON object"
MALFORMED = "response JSON is malformed"


def extract_json(responses: DataFrame, col: str = "raw_text") -> DataFrame:
    """Add `json_text` (first opening to last closing brace), `parsed` and `response_error`."""
    found = F.regexp_extract(F.col(col), r"(?s)\{.*\}", 0)
    has_braces = F.col(col).contains("{") & F.col(col).contains("}")
    parsed = F.try_parse_json(F.col("json_text"))
    texts = computed_once(responses, {"json_text": F.nullif(found, F.lit(""))})
    return (
        computed_once(texts, {"parsed": parsed})
        .withColumn(
            "response_error",
            F.when(~F.coalesce(has_braces, F.lit(False)), F.lit(NO_OBJECT)).when(
                F.col("parsed").isNull(), F.lit(MALFORMED)
            ),
        )
    )


def _text(path: str, default: str) -> Column:
    """String value of a field; the default only when the field is absent."""
    value = F.try_variant_get("parsed", path, "variant")
    return (
        F.when(value.isNull(), F.lit(default))
        .when(F.is_variant_null(value), F.lit("None"))
        .otherwise(F.coalesce(F.try_variant_get("parsed", path, "string"), F.lit(default)))
    )


def validate_response(responses: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Decision columns from a parsed response.

    An unknown action or a confidence below the minimum gives an undecided action; a
    confidence that is not a number counts as zero, others are clamped to [0, 1].
    """
    action = F.try_variant_get("parsed", "$.recommended_action", "string")
    kind = F.schema_of_variant(F.try_variant_get("parsed", "$.confidence", "variant"))
    numeric = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    number = F.when(numeric, F.try_variant_get("parsed", "$.confidence", "double")).when(
        kind == "BOOLEAN", F.try_variant_get("parsed", "$.confidence", "boolean").cast("double")
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0))))
    decided = F.col("_action").isin(*policy.allowed_actions) & (
        F.col("_confidence") >= policy.min_confidence
    )
    return (
        responses.withColumns({"_action": action, "_confidence": clamped})
        .withColumn(
            "predicted_action",
            F.when(decided, F.col("_action")).otherwise(F.lit(cfg.UNDECIDED)),
        )
        .withColumns(
            {
                "strategy_used": F.lit(cfg.STRATEGY_FALLBACK),
                "confidence": F.round("_confidence", 4),
                "risk_level": pick("predicted_action", policy.action_risk),
                "requires_approval": pick("predicted_action", policy.needs_approval),
                "summary": _text("$.summary", ""),
                "root_cause": _text("$.root_cause", ""),
                "reason": _text("$.reason", cfg.TEXT_FALLBACK_REASON),
                "missing_context": F.coalesce(
                    F.try_variant_get("parsed", "$.missing_context", "array<string>"),
                    F.array().cast("array<string>"),
                ),
            }
        )
        .drop("_action", "_confidence")
    )


def response_decisions(
    responses: DataFrame, policy: cfg.DecisionPolicy, col: str = "raw_text"
) -> tuple[DataFrame, DataFrame]:
    """(validated decisions, unusable responses with their error)."""
    rows = extract_json(responses, col)
    good = validate_response(rows.filter(F.col("response_error").isNull()), policy)
    bad = rows.filter(F.col("response_error").isNotNull())
    return good.drop("parsed", "json_text", "response_error"), bad.drop("parsed", "json_text")
