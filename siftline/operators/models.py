"""Training and batch scoring with MLlib over the exact feature block."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.durable import durable
from siftline.functions.hashing import fingerprint, lane_sums, row_digest
from siftline.functions.once import computed_once
from siftline.operators import evaluation, policy, routing, split
from siftline.operators.features import FEATURES, FeatureSpace, TextSetting, fit_space


@dataclass(frozen=True)
class Variant:
    """One model of an experiment. family: logistic, one_vs_rest or tree."""

    name: str
    family: str
    use_manual: bool = True
    use_text: bool = True
    params: dict = field(default_factory=dict)
    text: TextSetting = TextSetting()

    @property
    def manual(self) -> tuple[str, ...]:
        return cfg.FEATURE_NAMES if self.use_manual else ()

    @property
    def setting(self) -> TextSetting | None:
        return self.text if self.use_text else None


# The two families of the model comparison.
DEFAULT_VARIANTS = (
    Variant("manual_tfidf_logistic_regression", "logistic", params={"strength": 1.0}),
    Variant("manual_tfidf_one_vs_rest_log_loss", "one_vs_rest", params={"alpha": 1e-4, "tol": 1e-3}),
)


def variant_vectors(space: FeatureSpace, rows: DataFrame, variant: Variant, cells: DataFrame | None = None) -> DataFrame:
    """Rows with the feature vector of a variant."""
    return space.vectors(rows, variant.setting, variant.manual, cells)


def build_estimator(variant: Variant, n_train: int, settings: cfg.TrainingSettings):
    """Estimator of a variant. An inverse strength C over n rows is a penalty of 1 / (C * n)."""
    common = {"featuresCol": FEATURES, "labelCol": "label", "maxIter": settings.max_iter}
    if variant.family == "logistic":
        strength = variant.params.get("strength", 1.0)
        return LogisticRegression(
            family="multinomial",
            standardization=False,
            regParam=1.0 / (strength * max(n_train, 1)),
            tol=variant.params.get("tol", 1e-4),
            **common,
        )
    if variant.family == "one_vs_rest":
        binary = LogisticRegression(
            standardization=False,
            regParam=variant.params["alpha"],
            tol=variant.params.get("tol", 1e-3),
            **common,
        )
        return OneVsRest(classifier=binary, featuresCol=FEATURES, labelCol="label")
    if variant.family == "tree":
        return DecisionTreeClassifier(featuresCol=FEATURES, labelCol="label", seed=settings.seed)
    raise ValueError(f"unknown model family: {variant.family}")


def class_probabilities(model: Model) -> Column:
    """Array of class probabilities; one-against-all margins become normalised sigmoids."""
    if not isinstance(model, OneVsRestModel):
        return vector_to_array("probability")
    margins = vector_to_array("rawPrediction")
    own = F.transform(margins, lambda m: 1.0 / (1.0 + F.exp(-m)))
    total = F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(own, lambda p: F.try_divide(p, total))


def batch_score(model: Model, rows: DataFrame) -> DataFrame:
    """Add `predicted_label` (first most probable class) and its `probability`."""
    drop = ("rawPrediction", "probability", "prediction", FEATURES)
    scored = computed_once(model.transform(rows), {"_classes": class_probabilities(model)})
    best = F.array_max("_classes")
    return (
        scored.drop(*drop)
        .withColumn("probability", best)
        .withColumn("predicted_label", (F.array_position("_classes", best) - 1).cast("int"))
        .drop("_classes")
    )


@dataclass(frozen=True)
class Fitted:
    variant: Variant
    space: FeatureSpace
    model: Model

    def score(self, rows: DataFrame, cells: DataFrame | None = None) -> DataFrame:
        return batch_score(self.model, variant_vectors(self.space, rows, self.variant, cells))


def fit_variant(
    train: DataFrame,
    variant: Variant,
    settings: cfg.TrainingSettings | None = None,
    space: FeatureSpace | None = None,
    cells: DataFrame | None = None,
) -> Fitted:
    """Fit features (unless a fitted space is given) and model on rows with manual features and `label`."""
    settings = settings or cfg.TrainingSettings()
    space = space or fit_space(train, (variant.text,))
    prepared = variant_vectors(space, train, variant, cells).select(FEATURES, "label").persist()
    try:
        return Fitted(variant, space, build_estimator(variant, prepared.count(), settings).fit(prepared))
    finally:
        prepared.unpersist()


def coefficients(fitted: Fitted) -> DataFrame:
    """The fitted logistic model as a table: class, feature_index (null: intercept), weight."""
    matrix, intercepts = fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector.toArray()
    rows = [(k, None, float(b)) for k, b in enumerate(intercepts)]
    rows += [(k, j, float(w)) for k, line in enumerate(matrix) for j, w in enumerate(line)]
    return F.broadcast(fitted.space.vocab.sparkSession.createDataFrame(rows, "class int, feature_index int, weight double"))


def feature_rows(space: FeatureSpace, rows: DataFrame, variant: Variant, *keep: str) -> DataFrame:
    """Long rows of the feature block: id, `keep`, feature_index, value; zeros are left out."""
    values = vector_to_array(FEATURES)
    pairs = variant_vectors(space, rows, variant).select(space.id_col, *keep, F.posexplode(values).alias("feature_index", "value"))
    return pairs.filter("value <> 0")


def score_by_table(table: DataFrame, cells: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """id, probabilities: softmax over classes of the margins, by joins over a coefficient table.

    `cells` are long feature rows, `rows` all ids (a row without features has the intercepts).
    """
    weights = table.filter("feature_index IS NOT NULL")
    intercepts = table.filter("feature_index IS NULL").select("class", F.col("weight").alias("intercept"))
    parts = cells.join(weights, "feature_index").groupBy(id_col, "class").agg(F.sum(F.col("value") * F.col("weight")).alias("part"))
    every = rows.select(id_col).join(F.broadcast(intercepts))
    margins = every.join(parts, [id_col, "class"], "left").withColumn("margin", F.col("intercept") + F.coalesce("part", F.lit(0.0)))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("class", "margin"))), lambda c: c["margin"])
    grouped = margins.groupBy(id_col).agg(listed.alias("_margins"))
    shifted = F.transform("_margins", lambda m: F.exp(m - F.array_max("_margins")))
    total = F.aggregate("_exps", F.lit(0.0), lambda t, e: t + e)
    return grouped.withColumn("_exps", shifted).select(id_col, F.transform("_exps", lambda e: e / total).alias("probabilities"))


def loss_gradient(table: DataFrame, scored: DataFrame, cells: DataFrame, n_train: int, penalty: float, id_col: str) -> DataFrame:
    """class, feature_index, gradient of the mean log loss plus its penalty at the coefficients.

    `scored` has id, label and probabilities of the training rows. All entries are zero at the optimum, which
    the convex loss has only one of.
    """
    each = scored.select(id_col, "label", F.posexplode("probabilities").alias("class", "p"))
    error = each.withColumn("error", (F.col("p") - (F.col("label") == F.col("class")).cast("double")) / n_train)
    slopes = cells.join(error, id_col).groupBy("class", "feature_index").agg(F.sum(F.col("error") * F.col("value")).alias("slope"))
    weights = table.filter("feature_index IS NOT NULL")
    joined = weights.join(slopes, ["class", "feature_index"], "left")
    return joined.select("class", "feature_index", (F.coalesce("slope", F.lit(0.0)) + penalty * F.col("weight")).alias("gradient"))


def run_metrics(scored: DataFrame, rules: cfg.DecisionPolicy) -> DataFrame:
    """One row of run metrics from scored test rows with their label."""
    pairs = scored.withColumnsRenamed({"label": "actual", "predicted_label": "predicted"})
    matrix = evaluation.confusion_matrix(pairs, cfg.KNOWN_ACTIONS)
    weakest = evaluation.weakest_class(evaluation.class_metrics(matrix))
    decided = policy.check_policy(routing.classifier_decision(scored, rules), rules)
    quality = evaluation.decision_quality(policy.check_contract(decided), rules.min_confidence)
    return quality.withColumns(
        {
            "combined_accuracy": evaluation.accuracy(pairs).select("accuracy").scalar(),
            "f1_macro": evaluation.macro_f1(matrix).select("f1_macro").scalar(),
            "combined_weakest_class_recall": weakest.select("weakest_class_recall").scalar(),
        }
    )


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def data_tags(rows: DataFrame, content: tuple[str, ...]) -> dict[str, str]:
    """Hashes of the data and of both parts of the split: one aggregate, one row."""
    parts = split.split_fingerprint(rows, *content).first()
    digest = rows.select(row_digest(*[F.col(c) for c in content]).alias("_digest"))
    whole = digest.agg(fingerprint(F.count("*"), lane_sums(F.col("_digest"))).alias("h")).first()["h"]
    names = ("split_sha256", "train_split_sha256", "test_split_sha256")
    return {"training_data_sha256": whole, **{name: parts[name] for name in names}}


def train_variants(
    rows: DataFrame,
    variants: tuple[Variant, ...] = DEFAULT_VARIANTS,
    group_id: str = "model-family",
    settings: cfg.TrainingSettings | None = None,
    rules: cfg.DecisionPolicy | None = None,
    changed_variable: str = "model_family",
    controlled: tuple[str, ...] = ("raw_data", "train_split", "test_split", "policy", "evaluation_code"),
    content: tuple[str, ...] = ("message", "label"),
    started: str = "2026-01-01 00:00:00",
) -> tuple[list[Fitted], DataFrame]:
    """Fit every variant on one shared split; returns the models and their run rows.

    rows: usable rows with `split`, unique `line_id`, the manual features and `label`. The vocabularies of all text settings
    are fitted together and every text is turned into vectors once for each setting. A run
    row has the tags, metrics and params that comparing and selecting runs asks for; its
    latencies are the scoring time of the test part by decision, in ms, as a batch has no other.
    """
    settings, rules = settings or cfg.TrainingSettings(), rules or cfg.DecisionPolicy()
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    wanted = tuple(dict.fromkeys(v.text for v in variants if v.use_text)) or (TextSetting(),)
    space = fit_space(train, wanted)
    cells = durable(space.text_cells(rows))
    shared = data_tags(rows, content) | {
        "policy_sha256": _digest(asdict(rules)),
        "evaluation_code_sha256": hashlib.sha256(inspect.getsource(evaluation).encode()).hexdigest(),
        "experiment_config_sha256": _digest([group_id, asdict(settings), [asdict(v) for v in variants]]),
        "comparison_group_id": group_id,
        "comparison_type": changed_variable,
        "changed_variable": changed_variable,
        "controlled_variables": ",".join(controlled),
        "experiment_name": group_id,
        "candidate_status": "not_evaluated",
        "current_candidate": "false",
        "promotion_reason": "not_evaluated",
        "run_owner": "training",
    }
    fitted, runs = [], None
    for variant in variants:
        one = fit_variant(train, variant, settings, space, cells)
        began = time.monotonic()
        scored = durable(one.score(test, cells))
        elapsed = (time.monotonic() - began) * 1000
        row = _run_row(scored, variant, shared, rules, settings, elapsed, started)
        fitted.append(one)
        runs = row if runs is None else runs.unionByName(row)
    return fitted, runs


def _run_row(
    scored: DataFrame, variant: Variant, shared: dict[str, str], rules: cfg.DecisionPolicy, settings: cfg.TrainingSettings, elapsed: float, started: str
) -> DataFrame:
    manual, text = list(variant.manual), asdict(variant.text) if variant.use_text else None
    tags = shared | {
        "variant_name": variant.name,
        "variant_type": variant.family,
        "model_family": variant.family,
        "feature_pipeline_name": "+".join(["manual"] * bool(manual) + ["tfidf"] * variant.use_text),
        "feature_pipeline_sha256": _digest([manual, text]),
        "vectorizer_name": "tfidf" if variant.use_text else "none",
    }
    params = {f"model_{k}": str(v) for k, v in variant.params.items()} | {
        "model_family": variant.family,
        "model_max_iter": str(settings.max_iter),
        "tfidf_ngram_range": f"[1, {variant.text.max_n}]",
        "tfidf_max_features": str(variant.text.max_features),
        **{k: tags[k] for k in ("feature_pipeline_name", "feature_pipeline_sha256", "variant_name", "experiment_config_sha256")},
    }

    def as_map(values: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    latency = F.round(F.try_divide(F.lit(elapsed), F.col("decision_count")), 4)
    latencies = {f"offline_decision_latency_{name}_ms": latency for name in ("p50", "p95", "max")}
    found = run_metrics(scored, rules).withColumns(latencies)
    names = [c for c in found.columns]
    metrics = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    return found.select(
        F.lit(f"{shared['comparison_group_id']}-{variant.name}").alias("run_id"),
        F.lit(variant.name).alias("run_name"),
        F.lit("FINISHED").alias("status"),
        F.lit(started).alias("start_time"),
        *[F.lit(v).alias(k) for k, v in tags.items()],
        *names,
        as_map(params).alias("params"),
        as_map(tags).alias("tags"),
        metrics.alias("metrics"),
    )
