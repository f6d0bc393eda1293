"""Deciding log lines as they arrive. No step keeps state, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftline import config as cfg
from siftline.operators.scoring import LinearModel
from siftline.plans.scoring import decide_and_trace
from siftline.sources.logs import number_lines
from siftline.sources.traces import append_traces, placed_records


def decide_stream(
    lines: DataFrame, model: LinearModel, rules: cfg.DecisionPolicy, manifest: DataFrame
) -> DataFrame:
    """The batch plan on a streaming frame of line_id and raw_log."""
    return decide_and_trace(lines, model, rules, manifest)


def start_trace_sink(
    decisions: DataFrame, path: str, checkpoint: str, available_now: bool = False, fmt: str = "parquet"
) -> StreamingQuery:
    """Append the trace records of a decision stream to a partitioned file sink."""
    records = placed_records(decisions)
    writer = (
        records.writeStream.format(fmt)
        .outputMode("append")
        .partitionBy("created_date", "id_prefix")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return writer.trigger(**trigger).start()


def decide_batch(
    placed: DataFrame, batch_id: int, model: LinearModel, rules: cfg.DecisionPolicy, manifest: DataFrame, path: str, fmt: str = "parquet"
) -> None:
    """One micro-batch of placed lines: numbered, decided and written as the batch of its number."""
    append_traces(decide_stream(number_lines(placed), model, rules, manifest), path, fmt=fmt, batch=f"stream-{batch_id:012d}")


def start_decisions(
    placed: DataFrame,
    model: LinearModel,
    rules: cfg.DecisionPolicy,
    manifest: DataFrame,
    path: str,
    checkpoint: str,
    available_now: bool = False,
    fmt: str = "parquet",
) -> StreamingQuery:
    """Decide the files of a folder (`logs.stream_placed_lines`) into the trace table of the batch jobs.

    Ids are those of a batch read, and a replayed micro-batch replaces what it wrote before.
    """

    def decide(frame: DataFrame, batch_id: int) -> None:
        decide_batch(frame, batch_id, model, rules, manifest, path, fmt)

    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return placed.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(**trigger).start()
