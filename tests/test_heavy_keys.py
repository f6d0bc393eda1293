"""Operators that have to stay exact when one key holds a large share of the rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.operators import audit, lookup, similarity, split, tfidf


def test_attach_heavy_light_and_absent_keys(spark):
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("key"),
    )
    dim = rows.filter("key IS NOT NULL AND key <> 'k7'").groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.length("key")).alias("size"), F.first(F.lit(None).cast("string")).alias("nothing")
    )
    want = {r.id: (len(r.key) if r.key and r.key != "k7" else None) for r in rows.collect()}
    for most in (7, 100, 10**6):
        out = lookup.attach(rows, dim, "key", "n", spread="id", target_rows=most)
        assert out.columns == ["id", "key", "size", "nothing"]
        assert {r.id: r.size for r in out.collect()} == want
        inner = lookup.attach(rows, dim, "key", "n", spread="id", how="inner", target_rows=most)
        assert {r.id for r in inner.collect()} == {k for k, v in want.items() if v is not None}


def test_attach_deals_every_key_to_small_parts(spark):
    """A third of the rows under one key, many under a few, a long tail, and a share without a key."""
    kind = F.when(F.col("id") % 3 == 0, "third").when(F.col("id") % 10 == 1, F.concat(F.lit("some"), (F.col("id") % 7).cast("string")))
    rows = spark.range(30_000).select("id", kind.when(F.col("id") % 10 == 2, None).otherwise(F.col("id").cast("string")).alias("key"))
    dim = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    parts = dim.select("key", "n", lookup.salts(F.col("n"), 50).alias("parts")).filter("parts > 1").collect()
    assert {r.key for r in parts} == {"third", *[f"some{k}" for k in range(7)]} and len(parts) <= 30_000 / 50
    assert all(r.n / r.parts <= 50 for r in parts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lookup.attach(rows, dim, "key", "n", spread="id", target_rows=50)
        placed = out.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in placed) == 30_000
        assert out.filter("key IS NULL AND least IS NOT NULL OR key IS NOT NULL AND least IS NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(Exception, match="occurs twice: third"):
        lookup.attach(rows, dim.unionByName(dim.filter("key = 'third'")), "key", "n", spread="id").collect()


DOCS = [
    (0, "The cat sat on the mat, the end"),
    (1, "the dog_1 sat; Größe 42 a b"),
    (2, "cat cat cat"),
    (3, "a b c"),
    (4, "the the é dog_1 end"),
]


def brute_tfidf(docs, fitted):
    tokens = {d: re.findall(r"(?u)\b\w\w+\b", t.lower()) for d, t in docs}
    fit_tokens = {d: re.findall(r"(?u)\b\w\w+\b", t.lower()) for d, t in fitted}
    df = Counter(t for ts in fit_tokens.values() for t in set(ts))
    idf = {t: math.log((1 + len(fitted)) / (1 + n)) + 1 for t, n in df.items()}
    out = {}
    for d, ts in tokens.items():
        w = {t: n * idf[t] for t, n in Counter(ts).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out |= {(d, t): v / norm for t, v in w.items()}
    return out


def test_tfidf_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc bigint, text string")
    train, test = docs.filter("doc < 3"), docs.filter("doc >= 3")
    want = brute_tfidf(DOCS[3:], DOCS[:3])
    for most in (1, 100):
        counts = tfidf.term_counts(train, "doc", "text")
        vocab = tfidf.vocabulary(counts, tfidf.document_count(train))
        rows = tfidf.weigh(tfidf.term_counts(test, "doc", "text"), vocab, "doc", target_rows=most).collect()
        assert {(r.doc, r.term) for r in rows} == set(want)
        assert all(abs(r.weight - want[r.doc, r.term]) < 1e-12 for r in rows)
    top = tfidf.vocabulary(tfidf.term_counts(docs, "doc", "text"), tfidf.document_count(docs), 2)
    assert [(r.term, r.corpus_count) for r in top.orderBy(F.desc("corpus_count"), "term").collect()] == [("the", 6), ("cat", 4)]


def test_ngrams(spark):
    docs = spark.createDataFrame([(0, "aa bb cc"), (1, "aa"), (2, "")], "doc bigint, text string")
    rows = tfidf.tokenize(docs, "doc", "text", max_n=3).collect()
    assert sorted((r.doc, r.term) for r in rows) == [
        (0, "aa"), (0, "aa bb"), (0, "aa bb cc"), (0, "bb"), (0, "bb cc"), (0, "cc"), (1, "aa")]


def test_split_against_brute_force(spark):
    labels = ["a"] * 201 + ["b"] * 10 + ["c"]
    rows = spark.createDataFrame(list(enumerate(labels)), "id bigint, label string")
    order = lambda i: (hashlib.md5(f"42|{i}".encode()).hexdigest(), i)
    want = set()
    for name in "abc":
        ids = sorted((i for i, v in enumerate(labels) if v == name), key=order)
        want |= set(ids[: math.ceil(0.4 * len(ids))])
    prints = []
    for n, broadcast in ((1, 3), (7, 3), (7, 1)):  # also with more strata than are broadcast
        out = split.stratified_split(rows.repartition(n), "label", "id", broadcast)
        assert {r.id for r in out.filter("split = 'test'").collect()} == want
        prints.append(split.split_fingerprint(out, "id", "label").first())
    assert len(set(prints)) == 1 and prints[0].train_size + prints[0].test_size == len(labels)
    changed = split.stratified_split(rows, "label", "id", 3).withColumn("label", F.lit("z"))
    assert split.split_fingerprint(changed, "id", "label").first().split_sha256 != prints[0].split_sha256


def vectors(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 8)).round(3)
    data[5] = 0.0
    data[7] = data[6]
    rows = [(i, f"log {i}", f"cause {i}", ("open_ticket", "ignore", "suggest_scale_up")[i % 3], data[i].tolist()) for i in range(n)]
    frame = spark.createDataFrame(
        rows, "incident_id bigint, log string, known_root_cause string, known_action string, embedding array<float>")
    return data.astype(np.float32).astype(float), frame


def test_top_incidents_against_brute_force_on_both_paths(spark):
    data, memory = vectors(spark)
    queries = memory.select(F.col("incident_id").alias("query_id"), "embedding")

    def cos(a, b):
        norm = math.sqrt(a @ a) * math.sqrt(b @ b)
        return 0.0 if norm == 0 else float(a @ b) / norm

    want = {}
    for q in range(len(data)):
        ranked = sorted(((round(cos(data[q], data[m]), 4), m) for m in range(len(data)) if m != q), key=lambda x: (-x[0], x[1]))
        want[q] = [(m, s) for s, m in ranked[:3]]
    for limits in ({}, {"block_rows": 13}, {"block_rows": 1}):
        out = similarity.top_incidents(queries, memory, threshold=0.5, exclude_same_id=True, **limits)
        got = {r.query_id: [(m.incident_id, m.similarity) for m in r.similar_incidents] for r in out.collect()}
        assert got == want
    exact = memory.select("incident_id", similarity.cosine(F.col("embedding"), F.col("embedding")).alias("c"))
    values = {r.incident_id: r.c for r in exact.collect()}
    assert values[5] == 0.0 and abs(values[6] - 1.0) < 1e-12


def test_top_incidents_without_memory_and_with_unusable_vectors(spark):
    _, memory = vectors(spark, 20)
    queries = spark.createDataFrame(
        [(1, [0.5] * 8), (2, None), (3, [1.0, 2.0]), (4, [float("nan")] * 8), (5, [])], "query_id bigint, embedding array<float>")
    odd = memory.limit(2).withColumn("incident_id", F.col("incident_id") + 100).withColumn("embedding", F.lit(None).cast("array<float>"))
    for limits in ({}, {"block_rows": 7}):
        for known, matches in ((memory.limit(0), 0), (memory.union(odd), 3)):
            out = similarity.top_incidents(queries, known, **limits)
            assert {r.query_id: len(r.similar_incidents) for r in out.collect()} == {1: matches, 2: 0, 3: 0, 4: 0, 5: 0}


def test_vote_takes_the_top_action_even_if_it_is_the_minority(spark):
    def hit(i, action, s):
        return (i, "log", "cause", action, s, s >= 0.8)

    rows = [
        (1, [hit(1, "ignore", 0.96), hit(2, "open_ticket", 0.9), hit(3, "open_ticket", 0.85)]),
        (2, [hit(1, "ignore", 0.79), hit(2, "ignore", 0.7), hit(3, "ignore", 0.6)]),
        (3, [hit(1, "ignore", 0.9), hit(2, "open_ticket", 0.9), hit(3, "suggest_scale_up", 0.9)]),
        (4, [hit(1, "suggest_scale_up", 0.8), hit(2, "suggest_scale_up", 0.1)]),
        (5, []),
    ]
    frame = spark.createDataFrame(rows, f"query_id bigint, similar_incidents array<{similarity._MATCH}>")
    rules = cfg.DecisionPolicy()
    out = {r.query_id: r for r in similarity.vote(frame, rules).collect()}
    assert [out[i].strong_and_consistent for i in range(1, 6)] == [True, False, False, True, False]
    made = {r.query_id: r for r in similarity.similarity_decision(frame, rules).collect()}
    assert set(made) == {1, 4} and made[1].predicted_action == "ignore" and made[4].requires_approval
    assert made[1].router_reason == cfg.TEXT_SIMILAR_EXACT and made[4].router_reason == cfg.TEXT_SIMILAR_AGREED


def test_patches_across_slices_and_in_one_hot_version(spark):
    builds = []
    for i in range(120):
        minor = 0 if i % 3 else 1
        builds.append((i, "n", 1, minor, f"2026010{1 + i // 40}-{i % 24:02d}{i % 60:02d}00", f"m{(i // 7) % 3}"))
    columns = "build_id bigint, name string, major int, minor int, timestamp string, model_sha256 string"
    frame = spark.createDataFrame(builds, columns)
    for h in cfg.CONTENT_HASHES[1:]:
        frame = frame.withColumn(h, F.lit("same"))
    want = {}
    for minor in (0, 1):
        patch, last = -1, None
        for b in sorted((b for b in builds if b[3] == minor), key=lambda b: (b[4], b[0])):
            patch = 0 if patch < 0 else patch + (b[5] != last)
            last = b[5]
            want[b[0]] = patch
    assert {r.build_id: r.patch for r in audit.resolve_patches(frame.repartition(5)).collect()} == want


def test_patches_of_one_version_within_an_hour_run_in_many_tasks(spark):
    builds = [(i, "n", 1, 0, f"20260101-10{i // 60 % 60:02d}{i % 60:02d}", f"m{(i // 3) % 5}") for i in range(6_000)]
    frame = spark.createDataFrame(builds, "build_id bigint, name string, major int, minor int, timestamp string, model_sha256 string").repartition(3)
    for h in cfg.CONTENT_HASHES[1:]:
        frame = frame.withColumn(h, F.lit("same"))
    patch, last, want = -1, None, {}
    for b in sorted(builds, key=lambda b: (b[4], b[0])):
        patch, last = (0 if patch < 0 else patch + (b[5] != last)), b[5]
        want[b[0]] = patch
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = audit.resolve_patches(frame)
        assert out.select(F.spark_partition_id()).distinct().count() > 1
        assert {r.build_id: r.patch for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
