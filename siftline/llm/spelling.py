"""Spelling variants: words one letter apart, and the frequent form each rare word belongs to.

Near words are found in a bit-sliced position index. For every (position, letter) a bitset tells
which words of a block have that letter there. All words of the block are read against it at
once: `exact` holds the words that agree so far, three more sets those with one replaced,
one skipped and one additional letter, whose positions are shifted by none, one back and one on.

Blocks are groups of words that can be near at all. A pair is near at one place, the length of its
common prefix; a segment [low, high) of places gets the words that share what lies outside
it. A group with too many words is cut into the two halves of its segment, down to one place,
where a group has no more words than letters, so no pair is lost and none is met twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.byte_runs import LATIN_LEAD, byte_table, checksums, cut_runs, shifted_checksums
from siftline.llm.common import slices, written

MIN_LENGTH, MIN_COUNT = 6, 5
DROP_MODULUS = 199
# A form is at least so many times as frequent.
FORM_FACTOR = 5
# Words of one group before it is cut, words of a block, rows of one task.
GROUP_WORDS, BLOCK_WORDS, TASK_ROWS = 2_048, 1_024, 40_000
BROADCAST_KEYS = 1_000_000
_LETTERS = byte_table((ord("a"), ord("z")))
# Runs up to this many bytes take the checksum of their document moved on by a table.
_TABLE_BYTES = 48


def _deletions(run: bytes, checksum: int, min_length: int) -> str | None:
    """The run without its code point number checksum % length; None if too little is left."""
    letters = run.decode()
    at = checksum % len(letters)
    return letters[:at] + letters[at + 1 :] if len(letters) > min_length else None


def _prefixes(ids: pa.Array) -> np.ndarray:
    return checksums([b":" if i is None else f"{i}:".encode() for i in ids.to_pylist()])


def slice_words(batch: pa.RecordBatch, modulus: int, min_length: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of a slice (doc_id, text) and how often each occurs."""
    runs, bounds = cut_runs(batch.column("text"), _LETTERS, latin=True)
    offsets = np.frombuffer(runs.buffers()[1], np.int64)[: len(runs) + 1]
    data = np.frombuffer(runs.buffers()[2], np.uint8)[: offsets[-1]]
    leads = np.concatenate([[0], np.cumsum(data == LATIN_LEAD)])
    size = np.diff(offsets)
    points = size - (leads[offsets[1:]] - leads[offsets[:-1]])
    # Without a letter a run of `min_length` is too short, so shorter runs never count.
    used = np.flatnonzero(points >= min_length)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[used]
    coded = runs.take(pa.array(used)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_pylist()
    sums, length = checksums(distinct)[codes], size[used]
    moved = shifted_checksums(_prefixes(batch.column("doc_id")), min(_TABLE_BYTES, int(length.max(initial=0))))
    hashed = moved[np.minimum(length, len(moved) - 1), doc] ^ sums
    for at in np.flatnonzero(length >= len(moved)):
        hashed[at] = zlib.crc32(distinct[codes[at]], int(moved[0, doc[at]]))
    changed = np.flatnonzero(hashed % modulus == 0)
    counts = np.bincount(codes, minlength=len(distinct)) - np.bincount(codes[changed], minlength=len(distinct))
    cut = Counter(_deletions(distinct[codes[at]], int(hashed[at]), min_length) for at in changed)
    cut.pop(None, None)
    whole = np.flatnonzero(counts)
    words = pc.take(coded.dictionary, pa.array(whole)).cast(pa.large_string())
    words = pa.concat_arrays([words, pa.array(list(cut), pa.large_string())])
    return words, np.concatenate([counts[whole], np.fromiter(cut.values(), np.int64, len(cut))]).astype(np.int64)


def count_words(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    modulus: int = DROP_MODULUS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, n of all words with enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, n = slice_words(batch, modulus, min_length)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def _positions(letters: np.ndarray, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Bitset over the rows for every (position, letter)."""
    index = {}
    for place in range(letters.shape[1]):
        column = letters[:, place]
        order = np.argsort(column, kind="stable")
        marks = np.flatnonzero(np.diff(column[order], prepend=-1))
        for rows in np.split(order, marks[1:]):
            letter = int(column[rows[0]])
            if letter:
                index[place, letter] = _bits(rows, width)
    return index


def _bits(rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width * 64, np.uint8)
    out[rows] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def near_sets(words: list[str], ends: np.ndarray, group: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
    """For every asked word (default: all) the bitset of near words of its own group.

    `ends` is the end of each word's segment: a pair whose common prefix is longer belongs to
    another segment, unless the segment reaches the end of the shorter word (then -1).
    """
    n, width = len(words), -(-len(words) // 64)
    length = np.fromiter(map(len, words), np.int64, n)
    most = int(length.max())
    letters = np.zeros((n, most + 1), np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    letters[np.arange(most + 1) < length[:, None]] = flat
    index = _positions(letters, width)
    nothing, everything = np.zeros(width, np.uint64), _bits(np.arange(n), width)
    asked = np.arange(n) if asked is None else asked
    letters, own = letters[asked], length[asked]

    def having(place: int, column: np.ndarray) -> np.ndarray:
        """Row by row the words with the asked letter at `place`; at its end a word has letter 0."""
        known, which = np.unique(column, return_inverse=True)
        return np.stack([index.get((place, int(x)), nothing) for x in known])[which]

    exact = np.repeat(everything[None, :], len(asked), axis=0)
    replaced, skipped, added = (np.zeros_like(exact) for _ in range(3))
    shared_end = np.zeros_like(exact)
    close = ends[asked]
    for place in range(most):
        column = letters[:, place]
        live = (place < own)[:, None]
        same, back, on = having(place, column), having(place - 1, column), having(place + 1, column)
        replaced = np.where(live, (replaced & same) | (exact & ~same), replaced)
        skipped = np.where(live, (skipped & back) | exact, skipped)
        added = np.where(live, (added | exact) & on, added)
        exact = np.where(live, exact & same, exact)
        done = close == place + 1
        shared_end[done] = exact[done]
    lengths = {x: _bits(np.flatnonzero(length == x), width) for x in np.unique(length).tolist()}
    of = [np.stack([lengths.get(int(x) + d, nothing) for x in own]) for d in (-1, 0, 1)]
    near = (skipped & of[0]) | (replaced & of[1]) | ((added | exact) & of[2])
    members = {g: _bits(np.flatnonzero(group == g), width) for g in np.unique(group[asked]).tolist()}
    return near & ~shared_end & np.stack([members[int(g)] for g in group[asked]])


def _first_bits(sets: np.ndarray) -> np.ndarray:
    """Lowest set bit of every row that has one."""
    place = (sets != 0).argmax(axis=1)
    word = sets[np.arange(len(sets)), place]
    low = word & (~word + np.uint64(1))
    return place * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)


def _block_results(rows: pd.DataFrame) -> pd.DataFrame:
    """n_near and the best near word of each row of a block of whole groups."""
    rows = rows.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
    words = rows["word"].tolist()
    n, group = rows["n"].to_numpy(), rows["group"].to_numpy()
    ends = np.where(rows["high"] < rows["short"], rows["high"], -1)
    # Both words of a pair lie in the segment of the shorter one: the longer ones are not compared.
    long = rows["word"].str.len().to_numpy() > rows["short"].to_numpy()
    outs = []
    step = max(64, (1 << 21) // max(64, len(words)))
    is_long = _bits(np.flatnonzero(long), -(-len(words) // 64))
    for start in range(0, len(words), step):
        asked = np.arange(start, min(start + step, len(words)))
        near = near_sets(words, ends, group, asked)
        near = np.where(long[asked][:, None], near & ~is_long, near)
        some = np.flatnonzero(near.any(axis=1))
        best = _first_bits(near[some])
        count = np.bitwise_count(near[some]).sum(axis=1).astype(np.int64)
        outs.append(pd.DataFrame({"word": [words[i] for i in asked[some]], "n_near": count, "best": [words[i] for i in best], "best_n": n[best]}))
    return pd.concat(outs, ignore_index=True)


_NEAR = "word string, n_near long, best string, best_n long"


def _near_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of whole groups, of `BLOCK_WORDS` words or one larger group."""
    rows = rows.sort_values(["key", "short", "low", "high"], ignore_index=True)
    ids = rows.groupby(["key", "short", "low", "high"], sort=False).ngroup().to_numpy()
    sizes = np.bincount(ids)
    rows = rows.assign(group=ids)[sizes[ids] > 1]
    sizes = sizes[sizes > 1]
    # Long words widen the index, so a block is bounded by its letters as well.
    letters = rows["word"].str.len().groupby(rows["group"]).max().to_numpy() * sizes
    starts, words, weight = [0], 0, 0
    for at, (size, wide) in enumerate(zip(sizes, letters)):
        if words and (words + size > BLOCK_WORDS or weight + wide > 64 * BLOCK_WORDS):
            starts.append(at)
            words = weight = 0
        words, weight = words + size, weight + wide
    edges = np.concatenate([[0], np.cumsum(sizes)])
    outs = [_block_results(rows.iloc[edges[a] : edges[b]]) for a, b in zip(starts, [*starts[1:], len(sizes)]) if b > a]
    return pd.concat(outs, ignore_index=True) if outs else pd.DataFrame({c: [] for c in ("word", "n_near", "best", "best_n")})


def _keyed(segments: DataFrame) -> DataFrame:
    """The key of a segment's group: what a word has before `low` and after `high`."""
    tail = F.expr("right(word, short - high)")
    head = F.expr("left(word, low)")
    return segments.withColumn("key", F.xxhash64("short", "low", "high", head, tail))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.expr("(low + high) div 2").cast("int")
    parts = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high"))
    )
    return rows.withColumn("_part", F.explode(parts)).select("word", "n", "short", "_part.low", "_part.high").filter("low < high")


def near_words(words: DataFrame, group_words: int = GROUP_WORDS, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n_near, best, best_n for words (a written table of word, n) with a word one letter apart.

    `best` is the most frequent near word, equal ones in code point order. No group of more than
    `group_words` words is left uncut unless its segment is one place.
    """
    size = F.length("word")
    # As the shorter word of a pair or as long as it, and as the longer one.
    whole = words.withColumn("short", F.explode(F.array(size, size - 1))).filter("short > 0")
    open_rows = _keyed(_halves(whole.select("word", "n", "short", F.lit(0).alias("low"), F.col("short").alias("high"))))
    ready = []
    group = ["key", "short", "low", "high"]
    while True:
        sizes = open_rows.groupBy(*group).count()
        large = written(sizes.filter((F.col("count") > group_words) & (F.col("high") - F.col("low") > 1)), "spelling-large")
        found = large.count()
        if not found:
            ready.append(open_rows)
            break
        # At most rows / group_words keys, of 20 bytes each.
        keys = large.select(*group, F.lit(True).alias("_large"))
        marked = open_rows.join(F.broadcast(keys) if found <= BROADCAST_KEYS else keys, group, "left")
        ready.append(marked.filter("_large IS NULL").drop("_large"))
        open_rows = written(_keyed(_halves(marked.filter("_large").select("word", "n", "short", "low", "high"))), "spelling-open")
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    tasks = max(1, -(-4 * words.count() // task_rows))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*group), F.lit(tasks)))
    found = bucketed.groupBy("bucket").applyInPandas(_near_in_bucket, _NEAR)
    # Most frequent first, then the smallest word: the minimum of (-n, word).
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f"))
    return merged.select("word", "n_near", F.col("f.w").alias("best"), (-F.col("f.m")).alias("best_n"))


def follow_forms(words: DataFrame) -> DataFrame:
    """Add `root` to a written table with word and form: the last word that forms lead to.

    A form is `FORM_FACTOR` times as frequent, so chains have at most log(n) steps and no
    circles. Each round doubles the reach of a link.
    """
    links = words.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = written(links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spelling-links")
        if not links.filter("moved").limit(1).count():
            break
        links = links.drop("moved")
    return words.join(links.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    modulus: int = DROP_MODULUS,
    factor: int = FORM_FACTOR,
    group_words: int = GROUP_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, of which one code point
    is dropped where the checksum of id and run asks for it. Null and empty texts have no
    words; a null id counts as an empty one; repeated rows count again. An empty table, or one
    without frequent words, gives no rows. Other columns are not read.
    """
    words = written(count_words(docs, min_length, min_count, modulus, id_col, text_col), "spelling-words")
    near = written(near_words(words, group_words), "spelling-near")
    is_form = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    return follow_forms(written(joined, "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")
