"""Decision traces: attaching them, the persisted record, lookup and hash audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.operators import lookup

MANIFEST_FIELDS = ("artifact_id", "artifact_path", "run_id", "git_sha", *cfg.CONTENT_HASHES)


def utc_text(col: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def attach_trace(
    decisions: DataFrame,
    manifest: DataFrame,
    line_id: str = "line_id",
    created_at: Column | None = None,
) -> DataFrame:
    """Add the `trace` struct of the one artifact described by the one-row `manifest`.

    The id is a digest of artifact and line, so a retried task writes the same id again.
    The manifest is read once as a scalar subquery, not joined.
    """
    stamp = utc_text(F.current_timestamp()) if created_at is None else created_at
    artifact = manifest.select(F.struct(*MANIFEST_FIELDS)).scalar()
    return (
        decisions.withColumn("_artifact", artifact)
        .withColumn(
            "trace",
            F.struct(
                F.sha2(
                    F.concat_ws("|", F.col("_artifact.artifact_id"), F.col(line_id).cast("string")),
                    256,
                ).alias("decision_id"),
                stamp.alias("created_at"),
                *[F.col(f"_artifact.{name}").alias(name) for name in MANIFEST_FIELDS],
            ),
        )
        .drop("_artifact")
    )


def trace_records(decisions: DataFrame, raw: str = "raw_log") -> DataFrame:
    """Rows to persist: ids, the request and the decision. A row without trace is left out."""
    rest = [c for c in decisions.columns if c != raw]
    return decisions.filter(F.col("trace").isNotNull()).select(
        F.col("trace.decision_id").alias("decision_id"),
        F.col("trace.created_at").alias("created_at"),
        F.struct(F.col(raw).alias("raw_log")).alias("request"),
        F.struct(*rest).alias("decision"),
    )


def untraced(decisions: DataFrame) -> DataFrame:
    """Decisions that may not be persisted."""
    return decisions.filter(F.col("trace").isNull())


def find_decisions(traces: DataFrame, wanted: DataFrame) -> DataFrame:
    """All wanted ids with their trace; `found` tells whether there is one."""
    hit = traces.withColumn("found", F.lit(True))
    return wanted.join(hit, "decision_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def audit_traces(traces: DataFrame, manifests: DataFrame, id_col: str = "decision_id") -> DataFrame:
    """Compare the five hashes of each trace with its artifact's manifest.

    Adds `manifest_found`, `mismatches` (hash names) and `audit_status`. An artifact may
    own most of the traces, so its manifest is attached with the heavy-key join.
    """
    per_artifact = traces.groupBy("artifact_id").agg(F.count("*").alias("_traces"))
    dim = manifests.select(
        "artifact_id",
        F.lit(True).alias("manifest_found"),
        *[F.col(h).alias(f"manifest_{h}") for h in cfg.CONTENT_HASHES],
    ).join(per_artifact, "artifact_id")
    rows = lookup.attach(traces, dim, "artifact_id", "_traces", spread=id_col)
    differing = [
        F.when(~F.col(h).eqNullSafe(F.col(f"manifest_{h}")), F.lit(h)) for h in cfg.CONTENT_HASHES
    ]
    found = F.coalesce("manifest_found", F.lit(False))
    return (
        rows.withColumn("manifest_found", found)
        .withColumn(
            "mismatches",
            F.when(F.col("manifest_found"), F.array_compact(F.array(*differing))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .withColumn(
            "audit_status",
            F.when(~F.col("manifest_found"), F.lit("manifest_missing"))
            .when(F.size("mismatches") > 0, F.lit("mismatch"))
            .otherwise(F.lit("ok")),
        )
        .drop(*[f"manifest_{h}" for h in cfg.CONTENT_HASHES])
    )
