"""Queries that train and apply models.

SQL cannot fit a model, but it can check one: the feature block is compared value by value, the
labels of the training lines follow from their level, so a fitted model has to predict them, and
the gradient of the convex loss has to vanish at the fitted coefficients.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.oracle_base import define, query
from catalog.registry import register
from catalog.texts import line_split
from siftline import config as cfg
from siftline.functions.durable import columnar, durable
from siftline.operators import models, routing
from siftline.operators.features import TextSetting

LOGISTIC, ONE_VS_REST = models.DEFAULT_VARIANTS
TREE = models.Variant("manual_tree", "tree", use_text=False)
TEXT_ONLY = models.Variant("text_logistic_regression", "logistic", use_manual=False)
SETTINGS = cfg.TrainingSettings(max_iter=200)
BIGRAMS = TextSetting(2)
MANUAL = len(cfg.FEATURE_NAMES)

define("line_toks", ("line_split",), r"SELECT line_id, split, regexp_extract_all(lower(message), '[\p{L}\p{N}_]{2,}') AS t FROM line_split")
define(
    "line_grams",
    ("line_toks",),
    "SELECT line_id, split, term, count(*) AS tf FROM (SELECT line_id, split, unnest(t) AS term FROM line_toks UNION ALL "
    "SELECT line_id, split, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM line_toks) GROUP BY ALL",
)


def _text_block(grams: int, name: str) -> None:
    """Relations of the text features with n-grams up to `grams`: vocabulary and weights."""
    kept = "" if grams > 1 else " AND NOT contains(term, ' ')"
    define(
        f"{name}_vocab",
        ("line_grams",),
        f"""SELECT term, row_number() OVER (ORDER BY term) - 1 AS k,
          ln((1e0 + (SELECT count(*) FROM line_split WHERE split = 'train')) / (1e0 + count(*))) + 1e0 AS idf
          FROM line_grams WHERE split = 'train'{kept} GROUP BY term""",
    )
    define(
        f"{name}_weights",
        ("line_grams", f"{name}_vocab"),
        f"""SELECT line_id, k, w / sqrt(sum(w * w) OVER (PARTITION BY line_id)) AS value
          FROM (SELECT line_id, k, tf * idf AS w FROM line_grams JOIN {name}_vocab USING (term))""",
    )


_text_block(1, "words")
_text_block(2, "bigrams")
_MANUAL_ROWS = " UNION ALL ".join(
    f"SELECT line_id, {k} AS feature_index, CAST({name} AS DOUBLE) AS value FROM line_split WHERE {name} <> 0"
    for k, name in enumerate(cfg.FEATURE_NAMES)
)


def _rows(spark, sf):
    """The split lines, parsed once: fitting and scoring read them many times."""
    return columnar(line_split(spark, sf))


def _train(rows):
    return rows.filter("split = 'train'")


def _fitted(rows, variant):
    return models.fit_variant(_train(rows), variant, SETTINGS)


def _block(spark, sf, setting):
    rows = _rows(spark, sf)
    space = models.fit_space(_train(rows), (setting,))
    variant = models.Variant("block", "logistic", text=setting)
    return models.feature_rows(space, rows, variant).select(
        "line_id", F.col("feature_index").cast("long").alias("feature_index"), F.round("value", 6).alias("value")
    )


def _block_sql(name):
    return query(
        f"SELECT line_id, CAST(feature_index AS BIGINT) AS feature_index, round(value, 6) AS value FROM ({_MANUAL_ROWS} UNION ALL "
        f"SELECT line_id, {MANUAL} + k, value FROM {name}_weights)",
        "line_split",
        f"{name}_weights",
    )


@register("m1_feature_vectors", _block_sql("words"))
def m1(spark, sf):
    return _block(spark, sf, TextSetting())


@register("m1_bigram_vectors", _block_sql("bigrams"))
def m1_bigrams(spark, sf):
    return _block(spark, sf, BIGRAMS)


# The label of a usable line is a function of its level, which the manual features hold.
_LEARNED = query(
    "SELECT line_id, label, label AS predicted_label, TRUE AS is_sure FROM line_split WHERE split = 'test'", "line_split"
)


def _scored(spark, sf, variant):
    rows = _rows(spark, sf)
    scored = _fitted(rows, variant).score(rows.filter("split = 'test'"))
    return scored.select("line_id", "label", "predicted_label", (F.col("probability") > 0.5).alias("is_sure"))


@register("m2_logistic_regression", _LEARNED)
def m2(spark, sf):
    return _scored(spark, sf, LOGISTIC)


@register("m3_one_vs_rest", _LEARNED)
def m3(spark, sf):
    return _scored(spark, sf, ONE_VS_REST)


@register("m4_manual_tree", _LEARNED)
def m4_tree(spark, sf):
    return _scored(spark, sf, TREE)


def _table_scores(spark, sf, variant):
    """Fitted model, its coefficient table, and the scores of all lines by joins over that table."""
    rows = _rows(spark, sf)
    fitted = _fitted(rows, variant)
    table = models.coefficients(fitted)
    cells = durable(models.feature_rows(fitted.space, rows, variant, "split"))
    return rows, fitted, table, cells, models.score_by_table(table, cells.drop("split"), rows, "line_id")


def _agreement(spark, sf, variant):
    rows, fitted, _, _, by_table = _table_scores(spark, sf, variant)
    scored = fitted.score(rows).join(by_table, "line_id")
    own = F.array_max("probabilities")
    return scored.select(
        "line_id",
        "label",
        (F.abs(own - F.col("probability")) < 1e-9).alias("same_probability"),
        (F.abs(F.get("probabilities", F.col("predicted_label")) - own) < 1e-9).alias("same_class"),
    )


def _optimum(spark, sf, variant):
    """Gradient of every coefficient, rounded to four digits without a signed zero."""
    rows, _, table, cells, by_table = _table_scores(spark, sf, variant)
    train = _train(rows)
    n_train = train.count()
    scored = by_table.join(train.select("line_id", "label"), "line_id")
    gradient = models.loss_gradient(table, scored, cells.filter("split = 'train'").drop("split"), n_train, 1.0 / n_train, "line_id")
    return gradient.select(
        F.col("class").cast("long").alias("class"),
        F.col("feature_index").cast("long").alias("feature_index"),
        (F.round("gradient", 4) + 0.0).alias("gradient"),
    )


_AGREES = query("SELECT line_id, label, TRUE AS same_probability, TRUE AS same_class FROM line_split", "line_split")


def _optimum_sql(first: int) -> str:
    return query(
        f"SELECT class, CAST(feature_index AS BIGINT) AS feature_index, 0e0 AS gradient FROM "
        f"(SELECT unnest(range({len(cfg.KNOWN_ACTIONS)})) AS class), "
        f"(SELECT unnest(range({first} + (SELECT count(*) FROM words_vocab))) AS feature_index)",
        "words_vocab",
    )


@register("m2_scores_by_table", _AGREES)
def m2_by_table(spark, sf):
    return _agreement(spark, sf, LOGISTIC)


@register("m4_text_only", _AGREES)
def m4_text(spark, sf):
    return _agreement(spark, sf, TEXT_ONLY)


@register("m4_text_optimum", _optimum_sql(0))
def m4_optimum(spark, sf):
    return _optimum(spark, sf, TEXT_ONLY)


NGRAMS = tuple(
    models.Variant(f"ngrams_1_{n}" + (f"_top_{most}" if most else ""), "logistic", params={"strength": 1.0}, text=TextSetting(n, most))
    for n, most in ((1, None), (2, None), (2, 12))
)
_RUN_COLUMNS = ("run_id", "comparison_group_id", "variant_name", "decision_count", "combined_accuracy", "f1_macro", "combined_weakest_class_recall", "policy_block_count")


def _runs_sql(group: str, names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return query(
        f"""SELECT '{group}-' || v AS run_id, '{group}' AS comparison_group_id, v AS variant_name, n AS decision_count,
        1e0 AS combined_accuracy, 1e0 AS f1_macro, 1e0 AS combined_weakest_class_recall, CAST(0 AS BIGINT) AS policy_block_count
        FROM (SELECT unnest([{listed}]) AS v), (SELECT count(*) AS n FROM line_split WHERE split = 'test')""",
        "line_split",
    )


@register("m5_train_variants", _runs_sql("model-family", [v.name for v in models.DEFAULT_VARIANTS]))
def m5(spark, sf):
    _, runs = models.train_variants(_rows(spark, sf), settings=SETTINGS, content=("raw_log", "message", "label"))
    return runs.select(*_RUN_COLUMNS)


@register("m5_ngram_tuning", _runs_sql("ngram-tuning", [v.name for v in NGRAMS]))
def m5_ngrams(spark, sf):
    _, runs = models.train_variants(_rows(spark, sf), NGRAMS, "ngram-tuning", SETTINGS, changed_variable="tfidf_ngram_range")
    return runs.select(*_RUN_COLUMNS)


@register(
    "m6_batch_score_decisions",
    query(
        """SELECT line_id, CASE label WHEN 0 THEN 'open_ticket' WHEN 1 THEN 'ignore' WHEN 2 THEN 'suggest_scale_up' END AS predicted_action,
        TRUE AS is_sure, label = 2 AS is_risky FROM line_split""",
        "line_split",
    ),
)
def m6(spark, sf):
    rows = _rows(spark, sf)
    decided = routing.classifier_decision(_fitted(rows, LOGISTIC).score(rows), cfg.DecisionPolicy())
    return decided.select(
        "line_id",
        F.coalesce("original_prediction", "predicted_action").alias("predicted_action"),
        (F.col("confidence") > 0.5).alias("is_sure"),
        (F.col("risk_level") != "low").alias("is_risky"),
    )
