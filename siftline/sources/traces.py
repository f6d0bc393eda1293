"""The table of decision traces, which grows by batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.hashing import fingerprint, lane_sums
from siftline.operators.trace import trace_records

_PREFIX_CHARS = 2


def _prefix(decision_id: Column) -> Column:
    return F.substring(decision_id, 1, _PREFIX_CHARS)


def placed_records(decisions: DataFrame, raw: str = "raw_log") -> DataFrame:
    """Trace records with day and id prefix; a decision without trace fails the job."""
    refusal = F.raise_error(F.lit("cannot persist a decision without trace"))
    present = F.when(F.col("trace").isNull(), refusal.cast("boolean")).otherwise(F.lit(True))
    records = trace_records(decisions.filter(present), raw)
    return records.withColumns(
        {
            "created_date": F.substring("created_at", 1, 10),
            "id_prefix": _prefix(F.col("decision_id")),
        }
    )


def content_batch(records: DataFrame) -> str:
    """Name of a batch from the ids in it, in any order: the same decisions are the same batch."""
    named = records.agg(fingerprint(F.count("*"), lane_sums(F.col("decision_id"))).alias("name"))
    return named.first()["name"][:32]


def append_traces(
    decisions: DataFrame,
    path: str,
    raw: str = "raw_log",
    fmt: str = "parquet",
    files_per_prefix: int = 1,
    batch: str | None = None,
) -> None:
    """Append records as one batch, partitioned by batch and by the first characters of the decision id.

    A batch that is written again replaces itself, so a repeated job or a replayed micro-batch
    leaves one copy. Without a name the batch is named by its decisions. Ids are digests, so the
    prefixes are even; raise `files_per_prefix` with the size of a batch.
    """
    records = placed_records(decisions, raw)
    name = content_batch(records) if batch is None else batch
    spread = F.pmod(F.xxhash64("decision_id"), F.lit(files_per_prefix))
    writer = records.withColumn("batch", F.lit(name)).repartition("id_prefix", spread).write
    writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.format(fmt).partitionBy("batch", "id_prefix").save(path)


def read_traces(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The stored records of all batches."""
    return spark.read.format(fmt).load(path)


def once_each(records: DataFrame) -> DataFrame:
    """One record per decision, the earliest, where batches overlap."""
    earliest = F.min_by(F.struct(*records.columns), F.struct("created_at", "batch"))
    return records.groupBy("decision_id").agg(earliest.alias("_r")).select("_r.*")


def read_decision(spark: SparkSession, path: str, decision_id: str, fmt: str = "parquet") -> DataFrame:
    """Record of one decision; only the partitions of its id prefix are listed and read."""
    stored = read_traces(spark, path, fmt).filter(
        (F.col("id_prefix") == decision_id[:_PREFIX_CHARS]) & (F.col("decision_id") == decision_id)
    )
    return stored.orderBy("created_at", "batch").limit(1)
