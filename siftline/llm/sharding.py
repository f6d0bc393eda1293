"""Reproducible shuffle into shards: a Feistel permutation of the global row numbers.

Rows are numbered 0 to n - 1 in an order that depends on ids and texts only, never on file
layout. A keyed Feistel network permutes the smallest power of two that holds n; numbers that
leave the range walk along their cycle until they return. The permuted number p gives
shard = p mod n_shards and slot = p div n_shards, so counts differ by at most one, slots are
gapless, and both can be computed for any row number without a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import mix64

ROUNDS = 6
# Rows numbered by one task; the number of buckets follows the table.
BUCKET_ROWS = 1 << 15


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round(half: np.ndarray, seed: int, turn: int) -> np.ndarray:
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64)
    return mix64(half + key)


def _once(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    left_bits, right_bits = _halves(n)
    one = np.uint64(1)
    mask = lambda bits: (one << np.uint64(bits)) - one
    left, right = x >> np.uint64(right_bits), x & mask(right_bits)
    if not inverse:
        for turn in range(ROUNDS):
            left, right = right, (left ^ _round(right, seed, turn)) & mask(left_bits)
            left_bits, right_bits = right_bits, left_bits
    else:
        for turn in reversed(range(ROUNDS)):
            left_bits, right_bits = right_bits, left_bits
            left, right = (right ^ _round(left, seed, turn)) & mask(left_bits), left
    return (left << np.uint64(right_bits)) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The seeded permutation of 0 .. n - 1 (or its inverse) at `rows`."""
    x = _once(np.asarray(rows).astype(np.uint64), n, seed, inverse)
    out = np.flatnonzero(x >= n)
    while len(out):
        x[out] = _once(x[out], n, seed, inverse)
        out = out[x[out] >= n]
    return x.astype(np.int64)


def number_rows(rows: DataFrame, n: int, key: str, order: list[str]) -> DataFrame:
    """Add `row_number` 0 .. n - 1: by hash bucket of `key`, inside it by `order`.

    Only narrow rows are shuffled. Bucket sizes come from a count of all rows; their offsets,
    one row for each BUCKET_ROWS rows of the table, are joined back.
    """
    n_buckets = max(1, -(-n // BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_bucket")
        .agg(F.count("*").alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        rows.withColumn("_in_bucket", F.row_number().over(inside) - 1)
        .join(offsets, "_bucket")
        .withColumn("row_number", F.col("_offset") + F.col("_in_bucket"))
        .drop("_bucket", "_in_bucket", "_offset")
    )


def shard_documents(
    docs: DataFrame, n_shards: int = 24, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts have size 8 and the checksum of no bytes; null and repeated ids are rows like
    any other; an empty table gives no rows; other columns are not read.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    n = docs.count()
    numbered = number_rows(slim, n, "doc_id", ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return (
        numbered.withColumn("_place", permuted("row_number"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            (F.col("_place") % n_shards).cast("int").alias("shard"),
            F.floor(F.col("_place") / n_shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
