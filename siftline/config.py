"""Typed settings: label sets, decision policy, selection policy, evidence contract."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They have to equal the published ones for results to agree.
# ---------------------------------------------------------------------------

KNOWN_SERVICES = ("payments", "web", "api")
KNOWN_LEVELS = ("ERROR", "INFO", "WARNING")
KNOWN_ACTIONS = ("open_ticket", "ignore", "scale_up")

FEATURE_NAMES = (
    "cpu",
    "cpu_missing",
    "memory",
    "memory_missing",
    "service_is_payments",
    "service_is_web",
    "service_is_api",
    "level_is_ERROR",
    "level_is_INFO",
    "level_is_WARNING",
    "has_timeout",
    "has_latency",
)

DISPLAY_ACTION = {
    "open_ticket": "open_ticket",
    "ignore": "ignore",
    "scale_up": "suggest_scale_up",
}

ALLOWED_ACTIONS = ("ignore", "open_ticket", "suggest_scale_up", "needs_more_context")

FORBIDDEN_ACTIONS = (
    "delete_database",
    "mass_rollback",
    "delete_resource",
    "change_iam",
    "terraform_apply",
    "kubectl_delete",
    "production_restart_without_approval",
)

ACTION_RISK = {
    "ignore": "low",
    "open_ticket": "low",
    "suggest_scale_up": "medium",
    "needs_more_context": "low",
}

ACTION_NEEDS_APPROVAL = {
    "ignore": False,
    "open_ticket": False,
    "suggest_scale_up": True,
    "needs_more_context": False,
}

UNDECIDED = "needs_more_context"

STRATEGY_CLASSIFIER = "manual_features_plus_tfidf"
STRATEGY_SIMILARITY = "embedding_similarity"
STRATEGY_FALLBACK = "llm_fallback"
STRATEGY_DISABLED = "llm_disabled"
STRATEGY_ERROR = "error_handler"

TEXT_LOW_CONFIDENCE = "Low confidence prediction. Model suggested %s, but confidence is below %s."
TEXT_PREDICTED = "Predicted %s based on combined manual features and TF-IDF text signals."
TEXT_ACCEPTED = "High confidence and low risk. Classifier decision accepted."
TEXT_DISABLED = "LLM fallback is disabled in this environment."
TEXT_DISABLED_ROUTE = "Classifier was not sufficient and embedding/LLM paths are disabled."
TEXT_SIMILAR = (
    "Classifier decision required additional evidence. "
    "Similar past incidents strongly supported this action."
)
TEXT_SIMILAR_EXACT = "Top similar incident was an exact or near-exact match."
TEXT_SIMILAR_AGREED = "Top similar incidents showed consistent action agreement."
TEXT_FALLBACK_ROUTE = (
    "Classifier was not sufficient and similar incidents were not strong enough. "
    "LLM fallback was used with available context."
)
TEXT_FALLBACK_REASON = "LLM fallback analysis"
TEXT_FAILED = "Prediction failed for this log: %s"
TEXT_POLICY_ALLOWED = "Decision allowed by policy."
TEXT_POLICY_FORBIDDEN = "Action '%s' is forbidden by policy."
TEXT_POLICY_HIGH_RISK = "High-risk decision requires human approval."
TEXT_POLICY_LOW_CONFIDENCE = "Confidence %s is below approval threshold %s."

RISK_LEVELS = ("low", "medium", "high")

# Tag (or tags) that pin each controlled variable of a comparison.
CONTROLLED_VARIABLE_TAG = {
    "raw_data": "training_data_sha256",
    "train_split": "train_split_sha256",
    "test_split": "test_split_sha256",
    "feature_pipeline": "feature_pipeline_sha256",
    "policy": "policy_sha256",
    "evaluation_code": "evaluation_code_sha256",
}

CONTENT_HASHES = (
    "model_sha256",
    "vectorizer_sha256",
    "known_actions_sha256",
    "config_sha256",
    "training_data_sha256",
)

# Metric, direction (+1: larger is better) and name of each "best run" title.
BEST_RUN_METRICS = (
    ("best_f1_macro", "f1_macro", 1),
    ("best_combined_accuracy", "combined_accuracy", 1),
    ("best_low_confidence_rate", "low_confidence_rate", -1),
    ("best_approval_required_rate", "approval_required_rate", -1),
    ("best_latency_p95", "offline_decision_latency_p95_ms", -1),
)

REQUIRED_GATE_CHECKS = (
    "policy_tests",
    "artifact_tests",
    "quality_gate_report_tests",
    "prediction_contract_tests",
    "smoke_prediction",
    "traceability_integration",
    "deterministic_test_suite",
)

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class DecisionPolicy:
    """Thresholds and action dimensions of the decision router and the policy check."""

    min_confidence: float = 0.75
    similarity_threshold: float = 0.80
    exact_similarity: float = 0.95
    approval_min_confidence: float = 0.70
    allowed_actions: tuple[str, ...] = ALLOWED_ACTIONS
    forbidden_actions: tuple[str, ...] = FORBIDDEN_ACTIONS
    action_risk: dict[str, str] = field(default_factory=lambda: dict(ACTION_RISK))
    needs_approval: dict[str, bool] = field(default_factory=lambda: dict(ACTION_NEEDS_APPROVAL))

    def __post_init__(self) -> None:
        for name in ("min_confidence", "approval_min_confidence"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")


@dataclass(frozen=True)
class MetricThreshold:
    metric: str
    at_least: bool
    threshold: float


@dataclass(frozen=True)
class SelectionPolicy:
    """Absolute thresholds and the gain over the baseline a candidate has to show."""

    name: str = "decision_engine_candidate_selection"
    version: str = "v1"
    thresholds: tuple[MetricThreshold, ...] = (
        MetricThreshold("f1_macro", True, 0.80),
        MetricThreshold("combined_weakest_class_recall", True, 0.70),
        MetricThreshold("low_confidence_rate", False, 0.20),
        MetricThreshold("approval_required_rate", False, 0.50),
        MetricThreshold("offline_decision_latency_p95_ms", False, 200.0),
    )
    minimum_f1_gain: float = 0.02
    ready: str = "candidate_ready"
    rejected: str = "candidate_rejected"
    review: str = "human_review_required"


@dataclass(frozen=True)
class EvidenceContract:
    """Keys a run has to carry before it may be promoted."""

    version: str = "v1"
    params: tuple[str, ...] = (
        "model_family",
        "model_max_iter",
        "feature_pipeline_name",
        "feature_pipeline_sha256",
        "variant_name",
        "experiment_config_sha256",
    )
    metrics: tuple[str, ...] = (
        "f1_macro",
        "combined_accuracy",
        "combined_weakest_class_recall",
        "low_confidence_rate",
        "approval_required_rate",
        "offline_decision_latency_p95_ms",
    )
    tags: tuple[str, ...] = (
        "candidate_status",
        "promotion_reason",
        "run_owner",
        "comparison_group_id",
        "variant_name",
        "comparison_type",
        "changed_variable",
        "training_data_sha256",
        "train_split_sha256",
        "test_split_sha256",
        "policy_sha256",
        "evaluation_code_sha256",
        "experiment_config_sha256",
    )
    artifacts: tuple[str, ...] = ("manifest.json", "promotion_report.md")


@dataclass(frozen=True)
class HistoryThresholds:
    """Limits of the next-experiment advice."""

    f1_delta: float = 0.02
    low_confidence_rate: float = 0.20
    weakest_recall: float = 0.70


@dataclass(frozen=True)
class TrainingSettings:
    """Expected training configuration, used for the split and for drift checks."""

    test_share: float = 0.4
    seed: int = 42
    max_iter: int = 1000
    ngram_range: str = "[1, 1]"
    max_features: str | None = None
