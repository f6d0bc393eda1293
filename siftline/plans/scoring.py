"""Log lines to policy-checked decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from siftline import config as cfg
from siftline.operators import parse, policy, routing, scoring, trace


def scored_lines(lines: DataFrame, model: scoring.LinearModel, raw: str = "raw_log") -> DataFrame:
    """Events, features, predicted label and probability; parse errors stay in the table."""
    return scoring.score(parse.extract_features(parse.parse_logs(lines, raw)), model)


def classified_lines(
    lines: DataFrame, model: scoring.LinearModel, rules: cfg.DecisionPolicy, raw: str = "raw_log"
) -> DataFrame:
    """Classifier decisions before routing."""
    return routing.classifier_decision(scored_lines(lines, model, raw), rules)


def decide_lines(
    lines: DataFrame, model: scoring.LinearModel, rules: cfg.DecisionPolicy, raw: str = "raw_log"
) -> DataFrame:
    """Parse, score, route without fallback, turn broken lines into error decisions, check policy.

    A chain of projections: the physical plan is a scan and one codegen stage.
    """
    decided = routing.route_without_fallback(classified_lines(lines, model, rules, raw), rules)
    return policy.apply_policy(routing.merge_errors(decided), rules)


def decide_and_trace(
    lines: DataFrame,
    model: scoring.LinearModel,
    rules: cfg.DecisionPolicy,
    manifest: DataFrame,
    line_id: str = "line_id",
    raw: str = "raw_log",
    created_at: Column | None = None,
) -> DataFrame:
    """Decisions with the trace of the artifact that made them."""
    return trace.attach_trace(decide_lines(lines, model, rules, raw), manifest, line_id, created_at)
