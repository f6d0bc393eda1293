"""Log line sources, batch and streaming.

A line is identified by its file and its number in the file, so reading again, with other split
sizes or in a stream, gives the same ids, and equal lines are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.operators.parse import clean_lines


def with_place(lines: DataFrame) -> DataFrame:
    """Text rows with their file and the start of their split."""
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def number_lines(placed: DataFrame) -> DataFrame:
    """line_id, raw_log from `with_place` rows; stripped, blanks dropped.

    Each split counts its lines; the number of a line is the lines of all splits of its file before
    its own plus its place there. Every task gets one row per split, and the lines stay where they are.
    """
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    splits = placed.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    shifts = splits.select("_file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    numbered = placed.join(F.broadcast(shifts), ["_file", "_block"])
    line_id = F.concat_ws(":", "_file", (F.col("_at") + F.col("_shift")).cast("string"))
    return clean_lines(numbered.select(line_id.alias("line_id"), F.col("value").alias("raw_log")))


def read_log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """line_id, raw_log from UTF-8 text files. A missing path fails; a blank line keeps its number."""
    return number_lines(with_place(spark.read.text(list(paths))))


def stream_placed_lines(spark: SparkSession, folder: str, max_files: int = 1_000) -> DataFrame:
    """Streaming rows for `number_lines` inside a micro-batch, which holds whole files."""
    return with_place(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder))


def stream_log_lines(spark: SparkSession, folder: str, max_files: int = 1_000) -> DataFrame:
    """Streaming lines of the files that arrive in a folder, by projections only.

    The id is a digest of file and text, so a replayed micro-batch gives the same ids but equal
    lines of a file share one; `stream_placed_lines` gives each line the id of `read_log_lines`.
    """
    placed = stream_placed_lines(spark, folder, max_files)
    digest = F.sha2(F.concat_ws("|", "_file", "value"), 256)
    return clean_lines(placed.select(digest.alias("line_id"), F.col("value").alias("raw_log")))
