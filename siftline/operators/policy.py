"""Policy check of decisions and the decision contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.numeric import two_decimals
from siftline.functions.text import fill

REQUIRED_FIELDS = (
    "strategy_used",
    "predicted_action",
    "confidence",
    "risk_level",
    "requires_approval",
    "reason",
)


def check_policy(decisions: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Add `policy_allowed` and `policy_reason`; tighten `requires_approval`.

    A forbidden action wins over the other two rules. The decision's own columns other
    than the approval flag stay as they are.
    """
    forbidden = F.col("predicted_action").isin(*policy.forbidden_actions)
    high = F.col("risk_level") == "high"
    low = F.col("confidence") < policy.approval_min_confidence

    forbidden_text = fill(cfg.TEXT_POLICY_FORBIDDEN, F.col("predicted_action"))
    low_text = fill(
        cfg.TEXT_POLICY_LOW_CONFIDENCE,
        two_decimals(F.col("confidence")),
        F.lit(f"{policy.approval_min_confidence:.2f}"),
    )
    approvals = F.concat_ws(
        " ", F.when(high, F.lit(cfg.TEXT_POLICY_HIGH_RISK)), F.when(low, low_text)
    )
    reason = (
        F.when(forbidden, forbidden_text)
        .when(high | low, approvals)
        .otherwise(F.lit(cfg.TEXT_POLICY_ALLOWED))
    )
    return decisions.withColumns(
        {
            "policy_allowed": ~forbidden,
            "policy_reason": reason,
            "requires_approval": F.col("requires_approval") | forbidden | high | low,
        }
    )


def apply_policy(decisions: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Policy check, with a remark of the policy appended to the decision's reason."""
    remark = F.concat(F.col("reason"), F.lit(" ["), F.col("policy_reason"), F.lit("]"))
    changed = F.col("policy_reason") != cfg.TEXT_POLICY_ALLOWED
    return check_policy(decisions, policy).withColumn(
        "reason", F.when(changed, remark).otherwise(F.col("reason"))
    )


def contract_violations(decisions: DataFrame, allowed_fields: tuple[str, ...] | None = None) -> Column:
    """Array of broken rules of the decision contract; empty when the row conforms."""
    checks = [
        F.when(F.col(name).isNull(), F.lit(f"{name}: missing")) for name in REQUIRED_FIELDS
    ]
    confidence = F.col("confidence")
    outside = F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    checks.append(F.when(outside, F.lit("confidence: out of range")))
    checks.append(
        F.when(~F.col("risk_level").isin(*cfg.RISK_LEVELS), F.lit("risk_level: unknown value"))
    )
    if allowed_fields is not None:
        for name in sorted(set(decisions.columns) - set(allowed_fields)):
            checks.append(F.lit(f"{name}: unknown field"))
    return F.array_compact(F.array(*checks))


def check_contract(
    decisions: DataFrame, allowed_fields: tuple[str, ...] | None = None
) -> DataFrame:
    """Add `violations` and `contract_ok`."""
    return decisions.withColumn(
        "violations", contract_violations(decisions, allowed_fields)
    ).withColumn("contract_ok", F.size("violations") == 0)
