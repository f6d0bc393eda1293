"""What several operators of the subpackage share: reading, durable tables and Arrow text helpers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folder = ""
# Bytes of text that one Arrow step handles at once, whatever the batch size is.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or a temporary one in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_folder
    _local_folder = _local_folder or tempfile.mkdtemp(prefix="siftline-llm-")
    return _local_folder


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, lost executors cost nothing."""
    path = os.path.join(shared_folder(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def give_back() -> None:
    """Return freed memory to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut where `column` passes `limit` bytes; a longer single row stays alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words (runs without ASCII white space) of all texts, and the offsets of each text's words.

    A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        offsets = np.concatenate([[0], np.cumsum(~empty)])[offsets]
    return flat, offsets


def coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Index of every word into the list of distinct words, and that list."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gather_ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the runs flat[starts[i] : starts[i] + lengths[i]]."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class RunCache:
    """Runs of numbers by string, computed in bulk for strings not seen before; no string twice in a call.

    `limit` strings are kept at most; past it the cache starts anew, so its memory is bounded
    and results do not depend on it.
    """

    def __init__(self, compute, limit: int = 600_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat numbers, and each word's start and length in them."""
        if len(self.place) > self.limit:
            self.clear()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [words[i] for i in unknown]
            flat, lengths = self.compute(new)
            at[unknown] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, at[unknown].tolist(), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.lengths = np.concatenate([self.lengths, lengths])
        starts = np.cumsum(self.lengths) - self.lengths
        return self.flat, starts[at], self.lengths[at]


# A key with more than this share of the rows, and at least so many of them, is joined apart.
HOT_SHARE, HOT_LEAST = 1 / 1000, 1_000


def join_uneven(rows: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of `rows` to `dim` (one row per key) that no heavy first key slows down.

    Keys with over a thousandth of the rows, so a thousand at most, are looked up in a
    broadcast of their rows of `dim`; all others take a shuffle. `rows` is read twice and should
    be a written table.
    """
    counts = rows.filter(F.col(keys[0]).isNotNull()).groupBy(keys[0]).agg(F.count("*").alias("n"))
    bound = max(HOT_LEAST, int(rows.count() * HOT_SHARE))
    hot = [r[0] for r in counts.filter(F.col("n") > bound).select(keys[0]).collect()]
    if not hot:
        return rows.join(dim, keys, "left")
    is_hot = F.coalesce(F.col(keys[0]).isin(hot), F.lit(False))
    few = dim.filter(F.col(keys[0]).isin(hot))
    return rows.filter(is_hot).join(F.broadcast(few), keys, "left").unionByName(rows.filter(~is_hot).join(dim.filter(~is_hot), keys, "left"))
