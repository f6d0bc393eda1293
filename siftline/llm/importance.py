"""Resampling towards a target distribution: documents that resemble target texts are drawn more often.

Runs of words are hashed into a fixed number of buckets. The gain of a bucket is the floored log ratio of
its smoothed shares in target and corpus; an array of gains scores every document, and a
Gumbel number that depends only on the id turns the best scores into a draw without replacement.
The cutoff is found by bracketing: a quantile sketch proposes a bracket, exact counts outside it
confirm or widen it, and only rows inside it are ever sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm.byte_runs import byte_table, checksums, cut_runs
from siftline.llm.common import slices, written

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Rows that a bracket may hold before it is sorted, and the sketch's relative rank error.
BRACKET_ROWS, SKETCH_ACCURACY = 50_000, 1_000
# Copies of one row that one output task numbers at most.
COPIES_A_TASK = 100_000
_WORD_BYTES = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def run_buckets(texts: pa.Array, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of all texts, the text each belongs to, and words per text."""
    words, bounds = cut_runs(texts, _WORD_BYTES)
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashed = checksums(distinct) % buckets
    found, owners = [hashed[codes]], [text]
    for length in range(2, max_run + 1):
        at = np.flatnonzero(text[length - 1 :] == text[: len(text) - length + 1]) if len(text) >= length else np.zeros(0, np.int64)
        joined = [b" ".join([distinct[codes[i + k]] for k in range(length)]) for i in at.tolist()]
        found.append(checksums(joined) % buckets)
        owners.append(text[at])
    return np.concatenate(found), np.concatenate(owners), np.diff(bounds)


def bucket_counts(texts: DataFrame, text_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. One row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(run_buckets(batch.column("text"), max_run, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed bucket shares, as integers."""
    buckets = len(corpus)
    ratio = (target + 1.0) * (corpus.sum() + float(buckets)) / ((corpus + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the id's digest; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score_documents(
    docs: DataFrame, gains: np.ndarray, max_run: int = MAX_RUN, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, owners, words = run_buckets(batch.column("text"), max_run, len(shared.value))
            n = np.bincount(owners, minlength=batch.num_rows)
            # Sums of integers below 2**53 are exact as doubles.
            total = np.bincount(owners, weights=shared.value[buckets], minlength=batch.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            columns = [batch.column("doc_id"), *map(pa.array, (words.astype(np.int64), n.astype(np.int64), weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


@dataclass(frozen=True)
class Cut:
    """The value at a rank, and how many rows lie before it and on it."""

    value: int
    before: int
    on: int


def select_rank(rows: DataFrame, column: str, rank: int, total: int, bracket_rows: int = BRACKET_ROWS, accuracy: int = SKETCH_ACCURACY) -> Cut:
    """The value at `rank` (from 1, ascending) among the `total` rows of a long column without nulls.

    A quantile sketch proposes two values around the rank. Exact counts below, on and between
    them confirm the bracket, or show on which side the rank lies; then that side is bracketed
    more widely. A bracket of at most `bracket_rows` rows is sorted.
    """
    low, high, below, inside = -(1 << 63), (1 << 63) - 1, 0, total
    slack = 2.0 / accuracy
    value = F.col(column)
    while inside > bracket_rows:
        held = rows.filter(value.between(low, high))
        share = (rank - below) / inside
        wanted = [max(0.0, share - slack), min(1.0, share + slack)]
        left, right = held.agg(F.percentile_approx(column, wanted, accuracy)).first()[0]
        parts = (value < left, value == left, (value > left) & (value < right), (value == right) & F.lit(left < right))
        under, on_left, between, on_right = held.agg(*[F.count_if(p) for p in parts]).first()
        if rank <= below + under:
            high, inside, slack = left - 1, under, min(0.5, slack * 2)
        elif rank <= below + under + on_left:
            return Cut(left, below + under, on_left)
        elif rank <= below + under + on_left + between:
            low, high, below, inside = left + 1, right - 1, below + under + on_left, between
        elif rank <= below + under + on_left + between + on_right:
            return Cut(right, below + under + on_left + between, on_right)
        else:
            passed = under + on_left + between + on_right
            low, below, inside, slack = right + 1, below + passed, inside - passed, min(0.5, slack * 2)
    # At most `bracket_rows` values.
    for found, n in rows.filter(value.between(low, high)).groupBy(column).count().orderBy(column).collect():
        if below + n >= rank:
            return Cut(found, below, n)
        below += n
    raise ValueError("the rank lies outside the rows")


_ORDER = ("_down", "_id", "n_features", "weight")


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """`scored` (a written table) with `rank`: 1, 2, 3 ... by descending score, ties by ascending doc_id.

    Of the documents with `min_words` words or more the best floor(percent * n / 100) are
    drawn, the others have a null rank. Further ties go to fewer features, then to the smaller
    weight; rows equal in all of that are copies, which are counted, not sorted. A null id comes last.
    """
    spark = scored.sparkSession
    usable = F.col("n_words") >= min_words
    # The order as ascending longs: the score falls, a null id has the largest key.
    keyed = scored.withColumns({"_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit((1 << 63) - 1))})
    pool = keyed.filter(usable)
    wanted = pool.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    # One cut per column of the order, each among the rows on the cuts before it.
    rest, left, total, cuts = pool, wanted, None, []
    for column in _ORDER:
        cut = select_rank(rest, column, left, rest.count() if total is None else total, bracket_rows)
        cuts.append(cut.value)
        left, total = left - cut.before, cut.on
        if left == total:
            break
        rest = rest.filter(F.col(column) == cut.value)
    place = F.struct(*_ORDER[: len(cuts)])
    edge = F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(_ORDER, cuts)])
    reached = F.coalesce(usable & (place <= edge), F.lit(False))
    others = keyed.filter(~reached).select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = keyed.filter(reached).groupBy(*_ORDER, "doc_id", "score").agg(F.count("*").alias("_n"))
    if left < total:
        # All columns were needed: the rows on the edge are copies of one row, `left` of them drawn.
        spare = drawn.filter(place == edge).withColumns({"_n": F.lit(total - left).cast("long"), "_first": F.lit(0).cast("long")})
        others = others.unionByName(_expanded(spare, columns, ranked=False))
        drawn = drawn.withColumn("_n", F.when(place == edge, F.lit(left)).otherwise(F.col("_n")))
    # Scores are floored thousandths of logarithms of doubles: fewer than 10**7 values, usually some 10**4.
    per_score = sorted((down, n) for down, n in drawn.groupBy("_down").agg(F.sum("_n")).collect())
    starts = np.cumsum([0, *[n for _, n in per_score]])
    offsets = spark.createDataFrame([(d, int(s)) for (d, _), s in zip(per_score, starts)], "_down long, _start long")
    before = W.partitionBy("_down").orderBy(*_ORDER[1:]).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = drawn.withColumn("_upto", F.sum("_n").over(before)).join(F.broadcast(offsets), "_down")
    first = F.col("_start") + F.col("_upto") - F.col("_n")
    return others.unionByName(_expanded(placed.withColumn("_first", first), columns, ranked=True))


def _expanded(rows: DataFrame, columns: list[str], ranked: bool) -> DataFrame:
    """`_n` rows for each row; many copies are dealt out in parts first."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES_A_TASK))
    dealt = rows.withColumn("_part", F.explode(parts)).withColumn("_from", F.col("_part") * COPIES_A_TASK)
    upto = F.least("_n", F.col("_from") + COPIES_A_TASK) - 1
    each = dealt.withColumn("_copy", F.explode(F.sequence("_from", upto)))
    rank = F.col("_first") + F.col("_copy") + 1 if ranked else F.lit(None)
    return each.select(*columns, rank.cast("long").alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """Every document with doc_id, n_features, weight, score and its rank in the draw.

    A null or empty text has no features, weight 0, and is not drawn where `min_words` is above 0. Repeated rows
    stay rows, each with a rank of its own. Empty documents give no rows; without target texts
    all target counts are 0. Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, max_run, buckets), bucket_counts(target, target_col, max_run, buckets))
    scored = written(score_documents(docs, gains, max_run, seed, id_col, text_col), "importance")
    return draw(scored, min_words, percent)
