"""Importance resampling, spelling variants, nearest neighbours and the classifier against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from siftline.llm import byte_runs, importance, neighbours, pii, quality_classifier, spelling
from siftline.llm.common import held_out, written
from siftline.llm.oracle import ORACLE
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, rank string, n long, word string, score string, vector string"


def table(spark, texts, ids=None):
    """A documents table with columns whose names operators use for their own results."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "r", 1, "w", "s", "v") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def odd_texts() -> list[str | None]:
    rnd = random.Random(5)
    atoms = [" ", "a", "B", "Éé", "zoo", "12", "\n", "\x00", "_", "×÷", "日本", "Straße", "naïve", "Ñandú", "😀", "-", "word"]
    texts: list[str | None] = ["".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    return [*texts, None, "", " \n", "long text again " * 30_000, "x" * 200_000, texts[0], texts[0]]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def importance_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def importance_rows(docs, target, max_run=1, buckets=10_000, min_words=20, percent=10):
    """Plain Python: every document's (doc_id, n_features, weight, score, rank)."""

    def features(text):
        words = importance_words(text)
        runs = [" ".join(words[i : i + n]) for n in range(1, max_run + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % buckets for r in runs], len(words)

    read = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, found, _ in read:
        s.update(found)
    for text in target:
        t.update(features(text)[0])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, found, n_words in read:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((n_words >= min_words, i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    pool = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = [(*r[1:], n + 1) for n, r in enumerate(pool[: len(pool) * percent // 100])]
    left = Counter(r[1:] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted([*drawn, *[(*r, None) for r in left.elements()]], key=str)


@pytest.mark.parametrize(("max_run", "buckets", "min_words", "percent"), [(1, 10_000, 20, 10), (3, 97, 1, 35), (2, 500, 0, 100)])
def test_importance_equals_brute_force(spark, max_run, buckets, min_words, percent):
    texts, target = odd_texts(), ["zoo word Straße", None, "", "naïve 12 a zoo"]
    got = importance.resample(table(spark, texts), table(spark, target), max_run, buckets, min_words, percent)
    expected = importance_rows(list(enumerate(texts)), target, max_run, buckets, min_words, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_importance_counts_copies_and_null_ids(spark):
    texts = ["zoo word " * 12] * 400 + ["a naïve text " * 9] * 300 + ["other " * 30] * 50
    ids = [None] * 250 + [7] * 450 + list(range(50))
    got = importance.resample(table(spark, texts, ids), table(spark, ["zoo"]), percent=60).collect()
    assert sorted((tuple(r) for r in got), key=str) == importance_rows(list(zip(ids, texts)), ["zoo"], percent=60)


@pytest.mark.parametrize("accuracy", [10, 1_000])
def test_rank_selection(spark, accuracy):
    rnd = random.Random(3)
    values = [rnd.choice([5, 5, 5, -2**62, rnd.randint(-1000, 1000), rnd.randint(-2**60, 2**60)]) for _ in range(3_000)]
    rows, ordered = written(spark.createDataFrame([(v,) for v in values], "x long"), "test"), sorted(values)
    for rank in (1, 2, 700, 1_500, 2_999, 3_000):
        cut = importance.select_rank(rows, "x", rank, len(values), bracket_rows=20, accuracy=accuracy)
        value = ordered[rank - 1]
        assert (cut.value, cut.before, cut.on) == (value, sum(v < value for v in values), values.count(value))


def spelling_rows(docs, min_length=6, min_count=5, modulus=199, factor=5):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    parents = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            parents[w[:k] + w[k + 1 :], k].add(w)
    near = defaultdict(set)
    for (rest, _), words in parents.items():
        for w in words:
            near[w] |= words - {w}
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(rows)


def variant_texts() -> list[str | None]:
    """Words with many near words: one letter changed, doubled, lost, in frequent and rare forms."""
    rnd = random.Random(11)
    letters, words = "abéÿ", []
    for _ in range(60):
        base = "".join(rnd.choice(letters) for _ in range(rnd.choice([6, 7, 7, 12])))
        words += [base] * rnd.choice([1, 5, 40, 300])
        for _ in range(8):
            k, how = rnd.randrange(len(base)), rnd.randrange(3)
            words += [base[:k] + rnd.choice(["", letters[how] + base[k], letters[how]]) + base[k + 1 :]] * rnd.choice([1, 5, 6, 30])
    rnd.shuffle(words)
    return [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]


@pytest.mark.parametrize("group_words", [2, 2_048])
def test_spelling_equals_brute_force(spark, group_words):
    texts = [*variant_texts(), *odd_texts()]
    ids = [None, None, *range(2, len(texts))]
    got = spelling.group_variants(table(spark, texts, ids), modulus=7, group_words=group_words).collect()
    expected = spelling_rows(list(zip(ids, texts)), modulus=7)
    assert sorted(tuple(r) for r in got) == expected
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] != r[2] for r in expected if r[1])


def test_spelling_over_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = spelling_rows([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r) for r in spelling.group_variants(docs).collect()) == expected


def test_near_sets_of_short_words(spark):
    words = ["a", "ab", "b", "abc", "ac", "aab", "ba", "éa", "é"]
    frame = written(spark.createDataFrame([(w, 10 - k) for k, w in enumerate(words)], "word string, n long"), "test")
    got = {r.word: r.n_near for r in spelling.near_words(frame, group_words=1).collect()}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    assert got == {w: c for w in words if (c := sum(near(w, x) for x in words if x != w))}


def test_checksums_move_on():
    prefixes = [b"1:", b"-77:", b":", "é".encode()]
    moved = byte_runs.shifted_checksums(byte_runs.checksums(prefixes), 9)
    for k, prefix in enumerate(prefixes):
        for word in (b"", b"a", b"zebra", "naïveté".encode()):
            assert int(moved[len(word), k]) ^ zlib.crc32(word) == zlib.crc32(prefix + word)


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, "r", 2.0, "t") for i, v in rows], "vec_id long, embedding array<float>, rank string, score double, tree string").repartition(3)


def nearest_rows(rows, every=20, k=20):
    kept = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in (i for i in kept if i % every == 0):
        scored = []
        for i, v in kept.items():
            if i != q:
                total = 0.0
                for x, y in zip(kept[q], v):
                    total += x * y
                scored.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def by_query(found):
    out = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def recall(got, expected):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in rows}) / len(rows) for q, rows in expected.items()])


def test_neighbours_of_the_table(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got, expected = by_query(neighbours.nearest(frame, segment_rows=100)), nearest_rows(rows)
    assert set(got) == set(expected) and recall(got, expected) >= 0.9


def test_neighbours_in_clusters_of_uneven_norms(spark):
    """Near groups, one of them large, norms from 0.2 to 5, and many equal vectors."""
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((12, 24))
    rows = []
    for i in range(1_500):
        centre = centres[0] if i % 3 == 0 else centres[i % 12]
        rows.append((i, (centre + 0.2 * rnd.standard_normal(24)) * (0.2 + 4.8 * (i % 7) / 6)))
    rows += [(i, rows[6][1]) for i in range(5_000, 5_600)]
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    got = by_query(neighbours.nearest(vectors_table(spark, rows), segment_rows=150))
    expected = nearest_rows(rows)
    assert recall(got, expected) >= 0.9
    exact = {(q, i): s for q, found in expected.items() for i, s in found}
    assert all(exact[q, i] == s for q, found in got.items() for i, s in found if (q, i) in exact)
    # A query whose own vector is repeated gets the copies with the smallest ids.
    assert got[5_000] == expected[5_000]


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, None]), (80, [nan, 1.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])]
    rows += [(3, [inf, 0.0]), (None, [1.0, 1.0]), (4, [1.0, 2.0, 3.0]), (5, []), (1, [0.5, 0.5]), (6, [0.5, -7.0]), (-20, [0.0, 3.0])]
    got = by_query(neighbours.nearest(vectors_table(spark, rows)))
    assert got == {0: [(1, 0.5), (6, 0.5), (-20, 0.0), (2, -1.0)], -20: [(1, 1.5), (0, 0.0), (2, -0.0), (6, -21.0)]}
    doubles = vectors_table(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert by_query(neighbours.nearest(doubles)) == got


def test_levels_rise_with_nearness():
    planes = neighbours.projections(16)
    grid, chances = neighbours.share_chances(16, planes)
    levels = neighbours.needed_levels(np.array([np.nan, -1.0, 0.0, 0.5, 0.9, 0.99, 1.0]), grid, chances, neighbours.TREES)
    assert list(levels) == sorted(levels) and levels[0] == 0 and levels[-1] == neighbours.DIGITS
    for level, cosine in zip(levels[3:], (0.5, 0.9, 0.99, 1.0)):
        assert (1 - np.interp(cosine, grid, chances) ** level) ** neighbours.TREES <= neighbours.MISS or level == 0


def test_empty_tables(spark):
    docs = table(spark, ["a b"]).limit(0)
    assert importance.resample(docs, docs).collect() == []
    assert spelling.group_variants(docs).collect() == []
    empty = vectors_table(spark, [(0, [1.0])]).limit(0)
    assert neighbours.nearest(empty).collect() == []
    assert neighbours.nearest(vectors_table(spark, [(0, [1.0])])).collect() == []
    alone = importance.resample(table(spark, ["only " * 30]), docs, percent=100).collect()
    assert [(r.doc_id, r.rank) for r in alone] == [(0, 1)]


def plain_ftrl(examples, n_slots, epochs):
    """Textbook follow-the-regularised-leader over dicts, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)
    a, b, l1, l2 = quality_classifier.ALPHA, quality_classifier.BETA, quality_classifier.L1, quality_classifier.L2
    ones = sum(label for _, label in examples)
    share = {1: len(examples) / 2 / ones, 0: len(examples) / 2 / (len(examples) - ones)}

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(epochs):
        for values, label in examples:
            w = {i: weight(i) for i in values}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in values.items())))))
            for i, v in values.items():
                g = share[label] * (p - label) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
                n[i] += g * g
    return [weight(i) for i in range(n_slots + 1)]


def test_classifier_weights_equal_a_plain_version(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["sea", "calm", "calm calm", "ROW", "x!!", "boat"]) for _ in range(rnd.randint(0, 9))) for _ in range(80)]
    docs = table(spark, [*texts, None])
    labels = spark.createDataFrame([(i, (i * 7) % 3 % 2) for i in range(81)], "doc_id long, quality int")
    got = quality_classifier.fit(docs, labels, slot_bits=9, max_labelled=50, epochs=3)
    # The bounded sample and its order come from hashed ids.
    ids = labels.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).withColumn("o", F.xxhash64(F.lit(7), "doc_id"))
    examples = []
    for r in ids.orderBy("o", "doc_id").collect():
        slots, bounds = quality_classifier.features(pa.array([texts[r.doc_id] if r.doc_id < 80 else None]), 9)
        count = Counter(slots.tolist())
        values = {i: float(np.float32(c / math.sqrt(len(slots)))) for i, c in count.items()} | {512: 1.0}
        examples.append((values, r.quality))
    assert got == pytest.approx(plain_ftrl(examples, 512, 3), abs=1e-5) and np.abs(got).max() > 0.1


def test_classifier_on_the_tables(spark):
    """Held out bad texts are rejected and good ones kept, on both small scales."""
    for folder in (SF, "/root/testdata/sf0.01"):
        docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
        scored = quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels))
        rows = scored.join(labels, "doc_id").select("quality", "held_out", "predicted").collect()
        for held in (False, True):
            bad = [r.predicted for r in rows if r.quality == 0 and r.held_out == held]
            good = [r.predicted for r in rows if r.quality == 1 and r.held_out == held]
            assert sum(bad) <= 0.3 * len(bad) and sum(good) >= 0.98 * len(good)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_operator_equals_its_sql(spark, duck, name):
    count, problems = compare(contract.queries()[name](spark, SF), duck, ORACLE[name])
    # Ranks and forms are null by contract where there is none.
    assert [p for p in problems if ": nullable " not in p] == [] and count > 0


def test_detector_scores_equal_the_fitted_trees(spark, monkeypatch):
    """The SQL expression gives what MLlib's model gives on the same candidates."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    held = {}
    fit = GBTClassifier.fit

    def keep(self, frame):
        held["model"], held["frame"] = fit(self, frame), frame
        return held["model"]

    monkeypatch.setattr(GBTClassifier, "fit", keep)
    detector = pii.fit_detector(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    scored = held["model"].transform(held["frame"]).select(
        F.get(vector_to_array("probability"), F.lit(1)).alias("model"), detector.score(F.struct(*pii.FEATURES)).alias("own")
    )
    rows = scored.collect()
    assert len(rows) > 50 and max(abs(r.model - r.own) for r in rows) < 1e-9 and len({round(r.own, 6) for r in rows}) > 1


def test_detector_adds_spans_to_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find_personal_data(docs, pii.fit_detector(docs)).select("base", "spans").collect()
    for r in found:
        assert {(s.kind, s.start, s.end) for s in r.base} <= {(s.kind, s.start, s.end) for s in r.spans}
        for s in r.spans:
            assert s.kind in pii.BASE_KINDS or all(s.end <= b.start or b.end <= s.start for b in r.base)
    assert sum(len(r.spans) - len(r.base) for r in found) > 0


def test_long_lists_of_spans(spark):
    """A text of 32,000 addresses and numbers: positions are exact and the work stays in proportion."""
    text = "jo@x.com 4111 1111 1111 1112, " * 32_000
    detector = pii.Detector([(1.0, 0.3)], {"number_like": 0.1})
    row = pii.find_personal_data(table(spark, [text]), detector).first()
    size = len("jo@x.com 4111 1111 1111 1112, ")
    assert [(s.start, s.end) for s in row.base] == [(k * size, k * size + 8) for k in range(32_000)]
    assert [(s.start, s.end) for s in row.spans if s.kind == "number_like"] == [(k * size + 9, k * size + 28) for k in range(32_000)]
