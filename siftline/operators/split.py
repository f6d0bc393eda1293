"""Deterministic stratified split and its fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions.durable import durable
from siftline.functions.hashing import fingerprint, lane_sums, row_digest
from siftline.operators.lookup import attach

# Leading hex digits of the order hash that form a cell: 16**5, about a million cells per
# stratum, so a cell holds a millionth of a stratum's rows.
_CELL_DIGITS = 5


def order_hash(seed: int, id_col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string")))


def split_cutoffs(rows: DataFrame, strata: str, id_col: str, test_share: float, seed: int) -> DataFrame:
    """Per stratum the last (hash, id) that still belongs to the test part, and its row count.

    The rank is found by counting: rows per hash cell first, then only the rows of the
    one cell the cut falls into. A stratum is never sorted as a whole.
    """
    keyed = rows.select(
        F.col(strata).alias("_stratum"),
        F.struct(order_hash(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("id")).alias("_key"),
    ).withColumn("_cell", F.substring("_key.h", 1, _CELL_DIGITS))
    cells = keyed.groupBy("_stratum", "_cell").agg(F.count("*").alias("_n"))
    per_stratum = W.partitionBy("_stratum")
    cut = (
        cells.withColumn("_upto", F.sum("_n").over(per_stratum.orderBy("_cell")))
        .withColumn("_rows", F.sum("_n").over(per_stratum))
        .withColumn("_wanted", F.ceil(F.lit(test_share) * F.col("_rows")))
        .filter("_wanted > _upto - _n AND _wanted <= _upto")
        .select("_stratum", "_cell", "_rows", (F.col("_wanted") - (F.col("_upto") - F.col("_n"))).alias("_left"))
    )
    inside = keyed.join(cut, ["_stratum", "_cell"])
    rank = F.row_number().over(W.partitionBy("_stratum", "_cell").orderBy("_key"))
    return (
        inside.withColumn("_rank", rank)
        .filter("_rank = _left")
        .select(F.col("_stratum").alias(strata), F.col("_key").alias("_cutoff"), "_rows")
    )


def stratified_split(
    rows: DataFrame,
    strata: str,
    id_col: str,
    max_strata: int,
    test_share: float = 0.4,
    seed: int = 42,
) -> DataFrame:
    """Add `split` ('test' or 'train'): in every stratum the first ceil(share * n) rows by
    hashed id are the test part.

    Up to `max_strata` cut-offs are broadcast; more of them, by count, take the join that splits
    heavy keys. The result is the same.
    """
    if max_strata > 10_000:
        raise ValueError("too many cut-offs to broadcast")
    cutoffs = durable(split_cutoffs(rows, strata, id_col, test_share, seed))
    if cutoffs.limit(max_strata + 1).count() <= max_strata:
        placed = rows.join(F.broadcast(cutoffs.drop("_rows")), strata, "left")
    else:
        placed = attach(rows, cutoffs, strata, "_rows", id_col)
    key = F.struct(order_hash(seed, F.col(id_col)).alias("h"), F.col(id_col).alias("id"))
    in_test = F.coalesce(key <= F.col("_cutoff"), F.lit(False))
    return (
        placed
        .withColumn("split", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))
        .drop("_cutoff")
    )


def split_fingerprint(rows: DataFrame, *content: str) -> DataFrame:
    """Sizes and digests of the train part, the test part and both.

    One map-side combined aggregate; the digest of a part does not depend on row order.
    """
    hashed = rows.select("split", row_digest(*[F.col(c) for c in content]).alias("_digest"))
    parts = {}
    for part in ("train", "test"):
        keep = F.col("split") == part
        parts[f"{part}_size"] = F.count_if(keep)
        parts[f"{part}_split_sha256"] = fingerprint(
            F.count_if(keep), lane_sums(F.col("_digest"), keep)
        )
    sums = hashed.agg(*[value.alias(name) for name, value in parts.items()])
    return sums.withColumn(
        "split_sha256", F.sha2(F.concat_ws("|", "train_split_sha256", "test_split_sha256"), 256)
    )
