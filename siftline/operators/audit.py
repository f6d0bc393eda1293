"""Lineage of runs and artifacts: same configuration, hash audits, versions, gate evidence."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline import config as cfg
from siftline.functions.durable import durable
from siftline.functions.hashing import row_digest
from siftline.operators import comparison, lookup

# Run tags that have to equal a manifest value.
AUDITED_TAGS = (
    "git_sha",
    "config_sha256",
    "training_config_sha256",
    "policy_sha256",
    "training_data_sha256",
    "model_sha256",
    "vectorizer_sha256",
    "known_actions_sha256",
    "artifact_id",
    "artifact_sha256",
)
MANIFEST_HASHES = (
    "config_sha256",
    "known_actions_sha256",
    "model_sha256",
    "policy_sha256",
    "training_config_sha256",
    "training_data_sha256",
    "vectorizer_sha256",
)
ARTIFACT_NAME = r"^(.+)-v([0-9]+)\.([0-9]+)\.([0-9]+)-([0-9]{8})-([0-9]{6})$"
REPORT_FIELDS = ("report_version", "generated_at", "run_id", "git_sha", "status")
ARTIFACT_FIELDS = ("artifact_id", "model_version", "created_at", "manifest_path")


def runs_with_config(runs: DataFrame, config_sha: str | None = None) -> DataFrame:
    """Runs with one configuration hash, newest first; by default that of the newest run."""
    if config_sha is None:
        newest = runs.agg(F.min_by("config_sha256", comparison.newest_first()).alias("c"))
        wanted = newest.select("c").scalar()
    else:
        wanted = F.lit(config_sha)
    return runs.filter(F.col("config_sha256") == wanted).orderBy(F.desc("start_time"), "run_id")


def decision_contract(policy: cfg.DecisionPolicy, version: str = "v1") -> dict:
    """The part of the policy that belongs to an artifact's identity."""
    return {
        "output_schema_version": version,
        "allowed_actions": sorted(policy.allowed_actions),
        "forbidden_actions": sorted(policy.forbidden_actions),
        "confidence_thresholds": {
            "min_for_suggestion": policy.min_confidence,
            "similarity_threshold": policy.similarity_threshold,
        },
        "action_risk": dict(policy.action_risk),
        "requires_approval": dict(policy.needs_approval),
    }


def artifact_fingerprint(files: Column, contract: dict) -> Column:
    """sha256 of the manifest identity as compact JSON with sorted keys.

    `files` is a map of role to file name; the hashes are manifest columns.
    """
    sorted_files = F.map_from_entries(F.array_sort(F.map_entries(files)))
    hashes = F.struct(*[F.col(h) for h in MANIFEST_HASHES])
    keep_nulls = {"ignoreNullFields": "false"}
    contract_text = json.dumps(contract, sort_keys=True, separators=(",", ":"))

    def text(name: str) -> Column:
        """The value as a JSON string: what stands between the brackets of a list of it."""
        listed = F.to_json(F.array(F.col(name).cast("string")))
        return F.when(F.col(name).isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))

    return F.sha2(
        F.concat(
            F.lit('{"artifact_type":'),
            text("artifact_type"),
            F.lit(f',"decision_contract":{contract_text},"files":'),
            F.to_json(sorted_files),
            F.lit(',"hashes":'),
            F.to_json(hashes, keep_nulls),
            F.lit(',"schema_version":'),
            text("schema_version"),
            F.lit("}"),
        ),
        256,
    )


def audit_run_tags(runs: DataFrame, manifests: DataFrame, id_col: str = "run_id") -> DataFrame:
    """Long rows: run, tag, recorded value, manifest value and OK, MISMATCH or NO_MANIFEST.

    Manifests carry every audited name as a column, artifact_sha256 included. Many runs may
    share an artifact, so the manifest is attached with the heavy-key join.
    """
    per_artifact = runs.groupBy("artifact_id").agg(F.count("*").alias("_runs"))
    dim = manifests.select(
        "artifact_id", *[F.col(t).alias(f"_m_{t}") for t in AUDITED_TAGS]
    ).join(per_artifact, "artifact_id")
    rows = lookup.attach(runs, dim, "artifact_id", "_runs", spread=id_col)
    status = []
    for name in AUDITED_TAGS:
        recorded, expected = F.col(name), F.col(f"_m_{name}")
        status.append(
            F.struct(
                F.lit(name).alias("tag"),
                recorded.alias("recorded"),
                expected.alias("expected"),
                F.when(F.col("_m_artifact_id").isNull(), F.lit("NO_MANIFEST"))
                .when(recorded.eqNullSafe(expected), F.lit("OK"))
                .otherwise(F.lit("MISMATCH"))
                .alias("status"),
            )
        )
    return rows.select(id_col, F.inline(F.array(*status)))


def parse_artifact_names(artifacts: DataFrame, col: str = "artifact_id") -> DataFrame:
    """Add name, major, minor, patch and timestamp; names of another shape are dropped."""
    part = {k: F.regexp_extract(F.col(col), ARTIFACT_NAME, k) for k in range(1, 7)}
    return artifacts.filter(F.col(col).rlike(ARTIFACT_NAME)).withColumns(
        {
            "name": part[1],
            "major": part[2].cast("int"),
            "minor": part[3].cast("int"),
            "patch": part[4].cast("int"),
            "timestamp": F.concat_ws("-", part[5], part[6]),
        }
    )


def artifact_name(name: Column, major: Column, minor: Column, patch: Column, stamp: Column) -> Column:
    """Directory name of an artifact version."""
    version = F.concat_ws(".", *[c.cast("string") for c in (major, minor, patch)])
    return F.concat(name, F.lit("-v"), version, F.lit("-"), stamp)


def latest_artifacts(parsed: DataFrame, col: str = "artifact_id") -> DataFrame:
    """Latest artifact per name, major and minor, by patch and then time stamp."""
    order = F.struct("patch", "timestamp")
    return parsed.groupBy("name", "major", "minor").agg(
        F.max_by(col, order).alias(col),
        F.max(order).alias("_last"),
        F.count("*").alias("artifact_count"),
    ).select("name", "major", "minor", col, "_last.patch", "_last.timestamp", "artifact_count")


def resolve_patches(
    builds: DataFrame,
    version: tuple[str, ...] = ("name", "major", "minor"),
    stamp: str = "timestamp",
    tie: str = "build_id",
) -> DataFrame:
    """Add `patch`: 0 for the first build of a version, plus one for each build whose content
    hashes differ from the build before it.

    A version may have most of the builds, all within an hour. Builds are dealt to ranges of (version,
    stamp, tie), which hold about as many rows each. Inside a range changes are counted build by build; a
    range leaves its first and last content and its changes for each version, and these
    are added up over the ranges of a version.
    """
    keys = list(version)
    hashed = builds.withColumn("_content", row_digest(*[F.col(h) for h in cfg.CONTENT_HASHES]))
    sliced = durable(hashed.repartitionByRange(*keys, stamp, tie).withColumn("_slice", F.spark_partition_id()))
    within = W.partitionBy(*keys, "_slice").orderBy(stamp, tie)
    before = F.lag("_content").over(within)
    changed = F.coalesce((F.col("_content") != before).cast("int"), F.lit(0))
    local = sliced.withColumn("_changed", changed).withColumn("_local", F.sum("_changed").over(within))

    order = F.struct(stamp, tie)
    ends = sliced.groupBy(*keys, "_slice").agg(
        F.min_by("_content", order).alias("_first"), F.max_by("_content", order).alias("_last")
    )
    changes = local.groupBy(*keys, "_slice").agg(F.sum("_changed").alias("_inside"))
    across = W.partitionBy(*keys).orderBy("_slice")
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    border = F.coalesce((F.col("_first") != F.lag("_last").over(across)).cast("int"), F.lit(0))
    carried = (
        ends.join(changes, [*keys, "_slice"])
        .withColumn("_border", border)
        .withColumn(
            "_carried",
            F.coalesce(F.sum("_inside").over(earlier), F.lit(0)) + F.sum("_border").over(across),
        )
        .select(*keys, "_slice", "_carried")
    )
    return (
        local.join(carried, [*keys, "_slice"])
        .withColumn("patch", (F.col("_local") + F.col("_carried")).cast("int"))
        .drop("_slice", "_content", "_changed", "_local", "_carried")
    )


def _empty_names(names: tuple[str, ...]) -> Column:
    blank = [F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) == "", F.lit(n)) for n in names]
    return F.array_compact(F.array(*blank))


def audit_gates(reports: DataFrame, checks: DataFrame, key: str = "gate_run") -> DataFrame:
    """Gate reports with the required fields, artifact fields, hashes and checks they lack.

    checks: gate_run, check, status, position. The last result of a check counts. Results
    are reduced to one column per required check before the join, whatever their number.
    """
    last = {
        f"_c{k}": F.max_by("status", F.when(F.col("check") == name, F.col("position")))
        for k, name in enumerate(cfg.REQUIRED_GATE_CHECKS)
    }
    state = checks.groupBy(key).agg(*[c.alias(n) for n, c in last.items()])
    failed = [
        F.when(~F.coalesce(F.col(f"_c{k}") == "passed", F.lit(False)), F.lit(name))
        for k, name in enumerate(cfg.REQUIRED_GATE_CHECKS)
    ]
    rows = reports.join(state, key, "left").withColumns(
        {
            "missing_fields": _empty_names(REPORT_FIELDS),
            "missing_artifact_fields": _empty_names(ARTIFACT_FIELDS),
            "missing_hashes": _empty_names(cfg.CONTENT_HASHES),
            "failed_checks": F.array_compact(F.array(*failed)),
        }
    ).drop(*last)
    # Problems in the order in which they stop the validation.
    problem = (
        F.when(F.size("missing_fields") > 0, F.lit("missing_report_fields"))
        .when(F.col("status") != "passed", F.lit("status_not_passed"))
        .when(F.size("missing_artifact_fields") > 0, F.lit("missing_artifact_fields"))
        .when(F.size("failed_checks") > 0, F.lit("missing_or_failed_checks"))
        .when(F.size("missing_hashes") > 0, F.lit("missing_manifest_hashes"))
    )
    return rows.withColumn("first_problem", problem).withColumn(
        "evidence_ok", F.col("first_problem").isNull()
    )
