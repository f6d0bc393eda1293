"""Joining a large table to one row per key, without trusting the key to be even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that stay together. A key with more of them is dealt to several parts.
TARGET_ROWS = 1_000_000
# Parts for rows without a key, which match nothing and need not meet.
_NULL_PARTS = 4_096


def salts(weight: Column, target_rows: int = TARGET_ROWS) -> Column:
    """Number of parts that keeps each part of a key at `target_rows` rows or fewer, as far as hashes are even."""
    return F.greatest(F.ceil(weight / F.lit(target_rows)), F.lit(1)).cast("int")


def attach(
    rows: DataFrame,
    dim: DataFrame,
    key: str,
    weight: str,
    spread: str,
    how: str = "left",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add the columns of `dim` to `rows`; a key that `dim` holds twice fails the job.

    `weight` is a column of `dim`, the rows per key; it is not part of the result. A key
    above `target_rows` is dealt to parts by the hash of `spread`, its row of `dim` is copied to every part,
    and one exchange of `rows` by key and part serves all keys. The list of such keys,
    which every task gets, has at most (rows / target_rows) entries.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    values = [c for c in dim.columns if c not in (key, weight)]
    twice = F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col("_key")))
    single = (
        dim.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("_key"))
        .agg(F.first(F.struct(*values)).alias("_dim"), F.max(weight).alias("_rows"), F.count("*").alias("_n"))
        .select("_key", "_dim", F.when(F.col("_n") > 1, twice.cast("int")).otherwise(salts(F.col("_rows"), target_rows)).alias("_parts"))
    )
    heavy = single.filter("_parts > 1").select(F.col("_key").alias("_heavy"), F.col("_parts").alias("_heavy_parts"))
    parted = single.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")

    key_text = F.col(key).cast("string")
    parts = F.when(key_text.isNull(), _NULL_PARTS).otherwise(F.coalesce("_heavy_parts", F.lit(1)))
    keyed = rows.join(F.broadcast(heavy), key_text == F.col("_heavy"), "left")
    joined = keyed.withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).withColumn("_key", key_text).join(parted, ["_key", "_part"], how)
    return joined.selectExpr(*[f"`{c}`" for c in rows.columns], *[f"_dim.`{c}` AS `{c}`" for c in values])
