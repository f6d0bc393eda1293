"""Quality scores from hashed word n-grams: logistic regression trained by follow-the-regularised-leader.

A text is read as words and runs of symbols. Single ones and neighbouring pairs are hashed into
a fixed number of slots; a text's score is the sigmoid of the sum of its slots' weights over
the root of their count. Training uses a bounded sample of labelled documents; no label, language,
source or id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import coded, give_back, held_out, mix64, slices, split_words

SLOT_BITS = 18
# Labelled documents that training reads at most, taken in the order of their hashed ids.
MAX_LABELLED = 16_384
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.1
THRESHOLD = 0.3
_PAIR, _TWICE, _CAPITALS = np.uint64(0x9E3779B97F4A7C15), np.uint64(11), np.uint64(13)


def features(texts: pa.Array, slot_bits: int = SLOT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all texts, and each text's bounds in them (n + 1 offsets).

    A word starting with one capital counts as lower case; a repeated word and a word all in
    capitals give a slot of their own beside the pair's.
    """
    spaced = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([^\pL\pN\s]+)", r" \1 ")
    words, bounds = split_words(spaced)
    codes, distinct = coded(words)
    lowered = [w.lower() if w[0].isupper() and not w[1:2].isupper() else w for w in distinct]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in lowered), np.uint64, len(distinct))
    capital = np.fromiter((len(w) > 1 and w.isupper() for w in distinct), bool, len(distinct))
    one = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    # Three columns per word: itself, its pair with the next word, its form.
    follows = np.ones(len(one), bool)
    follows[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = False
    after = np.roll(one, -1)
    same = follows & (one == after)
    pair = mix64(one * _PAIR + after)
    form = np.where(same, _TWICE, _CAPITALS)
    shown = same | (capital[codes] if len(codes) else same)
    table = np.stack([one, pair, form], axis=1)
    used = np.stack([np.ones(len(one), bool), follows, shown], axis=1)
    slots = (mix64(table[used]) >> np.uint64(64 - slot_bits)).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
    return slots, ends[bounds]


def margins(slots: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[slots])])
    counts = np.diff(bounds)
    return bias + (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(counts, 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Follow-the-regularised-leader state of a logistic regression; the bias is the last slot.

    `share` is what an example of each class counts, so that both weigh the same in sum and the
    rarer one is not scored by its rarity.
    """

    def __init__(self, n_slots: int, rows: int, ones: int):
        self.z, self.n = np.zeros(n_slots + 1), np.zeros(n_slots + 1)
        self.share = (rows / 2 / max(1, rows - ones), rows / 2 / max(1, ones))

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example; no slot may occur twice."""
        w, n = self.weights(slots), self.n[slots]
        gradient = self.share[label] * (sigmoid(w @ values) - label) * values
        grown = n + gradient * gradient
        self.z[slots] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = grown


def example(slots: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text and their values, the bias slot last."""
    distinct, counts = np.unique(slots, return_counts=True)
    return np.append(distinct, n_slots), np.append(counts / np.sqrt(max(1, counts.sum())), 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label) of at most `limit` labelled documents outside the held-out fifth."""
    chosen = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")  # `limit` rows at most


def fit(
    docs: DataFrame,
    labels: DataFrame,
    slot_bits: int = SLOT_BITS,
    max_labelled: int = MAX_LABELLED,
    epochs: int = EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> np.ndarray:
    """Slot weights and bias: float64 of 2**slot_bits + 1. Without labelled rows all are zero.

    The sample has a documented bound and is learned by one model, in the order of hashed ids. Every epoch
    is a copy of the sample; Spark sorts the copies and the one task that learns reads them as a
    stream, so its memory does not depend on how long the texts are.
    """
    n_slots = 1 << slot_bits
    sample = labelled_sample(docs, labels, max_labelled, id_col, text_col)
    rows, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not rows:
        return np.zeros(n_slots + 1)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            slots, bounds = features(batch.column("text"), slot_bits)
            made = [example(slots[a:b], n_slots) for a, b in zip(bounds[:-1], bounds[1:])]
            listed = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *listed], names=["doc_id", "label", "slots", "shares"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(n_slots, rows, ones)
        for batch in batches:
            slots, shares, marks = batch.column("slots"), batch.column("shares"), batch.column("label").to_pylist()
            for at, label in enumerate(marks):
                model.learn(slots[at].values.to_numpy(), shares[at].values.to_numpy().astype(np.float64), label)
            give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32)], pa.list_(pa.float32()))], names=["weights"])

    featured = sample.mapInArrow(featurise, "doc_id long, label int, slots array<int>, shares array<float>")
    # Copied where they are learned, so that the exchange moves every example once.
    copies = featured.repartition(1).withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    ordered = copies.sortWithinPartitions("epoch", F.xxhash64(F.lit(7), "doc_id"), "doc_id", "label").select("label", "slots", "shares")
    return np.asarray(ordered.mapInArrow(train, "weights array<float>").first()[0], np.float64)


def score_documents(
    docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no n-grams and get the score of the bias. Repeated rows and null
    ids stay rows (a null id is not held out); other columns are not read.
    """
    slot_bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # 4 bytes a slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in slices(batches, "text"):
            slots, bounds = features(batch.column("text"), slot_bits)
            scores = sigmoid(margins(slots, bounds, w, w[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_accepted(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose text scores at least `threshold`, all columns as they are."""
    weights = fit(train_docs, labels)
    slot_bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value.astype(np.float64)
        for batch in slices(batches, text_col):
            slots, bounds = features(batch.column(text_col), slot_bits)
            yield batch.filter(pa.array(sigmoid(margins(slots, bounds, w, w[-1])) >= threshold))

    return docs.mapInArrow(run, docs.schema)
