"""The exact feature block, its numbering and the checks of fitted models, on hand-made rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.operators import features, models, tfidf
from siftline.operators.features import TextSetting
from siftline.plans import selection as plans

TEXTS = ["db timeout db", "all fine here", "db fine é_1", "", "x y", None, "timeout timeout timeout all", "Ünder über all"]


def lines(spark, texts, n=None):
    rows = [(i, texts[i % len(texts)], i % 3, "train" if i % 5 < 3 else "test") for i in range(n or len(texts))]
    frame = spark.createDataFrame(rows, "line_id long, message string, label int, split string")
    return frame.select("*", *[(F.col("line_id") % (k + 2)).cast("int").alias(f) for k, f in enumerate(cfg.FEATURE_NAMES)])


def grams(text, n):
    tokens = re.findall(r"\w{2,}", (text or "").lower())
    return [" ".join(tokens[i : i + k]) for k in range(1, n + 1) for i in range(len(tokens) - k + 1)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_numbers(spark, partitions):
    keys = random.Random(1).sample(range(10**9), 3_000)
    frame = spark.createDataFrame([(f"k{k}",) for k in keys], "k string").repartition(partitions)
    got = {r.k: r.at for r in features.numbered(frame, ["k"], "at").collect()}
    assert got == {k: i for i, k in enumerate(sorted(f"k{k}" for k in keys))}
    assert features.numbered(frame.limit(0), ["k"], "at").collect() == []


@pytest.mark.parametrize("setting", [TextSetting(), TextSetting(2), TextSetting(2, 5), TextSetting(3, 1)])
def test_vectors_equal_a_plain_version(spark, setting):
    rows = lines(spark, TEXTS, 24)
    train = rows.filter("split = 'train'")
    space = features.fit_space(train, (TextSetting(1, 3), setting))
    docs = [grams(r.message, setting.max_n) for r in train.collect()]
    count, df = Counter(t for d in docs for t in d), Counter(t for d in docs for t in set(d))
    kept = sorted(count, key=lambda t: (-count[t], t.encode()))[: setting.max_features]
    index = {t: i for i, t in enumerate(sorted(kept, key=str.encode))}
    assert space.size(setting, cfg.FEATURE_NAMES) == len(cfg.FEATURE_NAMES) + len(index)
    got = {r.line_id: r.v for r in space.vectors(rows, setting).select("line_id", vector_to_array("features").alias("v")).collect()}
    assert len(got) == 24
    for r in rows.collect():
        tf = Counter(t for t in grams(r.message, setting.max_n) if t in index)
        weight = {index[t]: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        plain = [float(r[f]) for f in cfg.FEATURE_NAMES] + [weight.get(i, 0.0) / norm if norm else 0.0 for i in range(len(index))]
        assert got[r.line_id] == pytest.approx(plain, abs=1e-12)


def test_blocks_without_one_part(spark):
    rows = lines(spark, TEXTS)
    space = features.fit_space(rows.limit(0))
    assert space.size(TextSetting(), ()) == 0
    manual = space.vectors(rows, None).select(vector_to_array("features").alias("v")).collect()
    assert all(len(r.v) == len(cfg.FEATURE_NAMES) for r in manual) and len(manual) == len(TEXTS)


def test_coefficient_table_and_gradient(spark):
    rows = lines(spark, TEXTS, 90)
    variant = models.Variant("v", "logistic", text=TextSetting(2, 6))
    fitted = models.fit_variant(rows, variant, cfg.TrainingSettings(max_iter=500))
    table = models.coefficients(fitted)
    cells = models.feature_rows(fitted.space, rows, variant)
    scores = models.score_by_table(table, cells, rows, "line_id")
    own = {r.line_id: r.probabilities for r in scores.collect()}
    for r in fitted.score(rows).collect():
        assert max(own[r.line_id]) == pytest.approx(r.probability, abs=1e-12)
        assert own[r.line_id][r.predicted_label] == max(own[r.line_id])
    steep = models.loss_gradient(table, scores.join(rows.select("line_id", "label"), "line_id"), cells, 90, 1 / 90, "line_id")
    assert max(abs(r.gradient) for r in steep.collect()) < 1e-3


def test_tuning_runs_can_be_compared_and_selected(spark):
    rows = lines(spark, ["db timeout now", "all fine", "high latency"], 120)
    variants = [models.Variant(f"n{n}", "logistic", text=TextSetting(n)) for n in (1, 2)]
    _, runs = models.train_variants(rows, tuple(variants), "ngrams", cfg.TrainingSettings(max_iter=30), changed_variable="tfidf_ngram_range")
    runs = runs.cache()
    group = plans.history_report(runs).collect()
    assert len(group) == 1 and group[0].comparison_status == "valid" and group[0].run_count == 2
    artifacts = runs.select("run_id", F.explode(F.array(*[F.lit(a) for a in cfg.EvidenceContract().artifacts])).alias("path"))
    baselines = spark.createDataFrame([("ngrams", "ngrams-n1", False, None)], "comparison_group_id string, baseline_run_id string, allow_override boolean, override_reason string")
    picked = plans.select_candidates(runs, artifacts, baselines)
    assert picked.report.count() == 1 and picked.evaluations.count() == 2
    assert all(r.evidence_status == "passed" for r in picked.evaluations.collect())
    params = {r.variant_name: r.params["tfidf_ngram_range"] for r in runs.collect()}
    assert params == {"n1": "[1, 1]", "n2": "[1, 2]"}


def test_parts_of_a_term_count_follow_the_bytes_of_the_texts(spark, monkeypatch):
    """More text gives more parts, not larger ones; repeated and null ids still add up."""
    rows = spark.range(400).selectExpr("if(id % 4 = 0, null, id % 100) AS doc", "concat('ab cd ab ', repeat('x', 50)) AS text")
    whole = sorted(tfidf.term_counts(rows, "doc", "text", 2).collect(), key=str)
    monkeypatch.setattr(tfidf, "PART_BYTES", 1_000)
    parted = tfidf.term_counts(rows, "doc", "text", 2)
    assert parted.rdd.getNumPartitions() == 24 and sorted(parted.collect(), key=str) == whole
    assert {(r.doc, r.term): r.tf for r in whole}[(None, "ab")] == 200
    assert tfidf.term_counts(rows.limit(0), "doc", "text").count() == 0


def test_training_rows_are_parsed_once(spark, tmp_path, monkeypatch):
    """The rows that fitting and scoring read are a stored table, not the parser's plan over the events."""
    from catalog import training

    monkeypatch.setattr(training, "line_split", lambda spark, sf: lines(spark, TEXTS, 24).filter(F.lower("message") != "x y"))
    rows = training._rows(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan and "parquet" in plan
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, training.line_split(spark, "").collect()), key=str)
