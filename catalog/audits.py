"""Queries on lineage: configurations, hash audits, versions and gate evidence."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog import inputs
from catalog.oracle_base import define, query, sql_text
from catalog.registry import register
from siftline import config as cfg
from siftline.operators import audit, trace

define("traces", ("manifests",), inputs.TRACES.replace("SHA(", "sha256("))
define("tagged_runs", ("manifests",), inputs.TAGGED_RUNS.replace("SHA(", "sha256("))
define(
    "builds",
    (),
    inputs.BUILDS.replace("SHA(", "sha256(").replace("DAY(o_orderdate)", "strftime(o_orderdate, '%Y%m%d')"),
)
define("gate_checks", (), inputs.GATE_CHECKS)
define("gate_reports", ("manifests",), inputs.GATE_REPORTS)

CONTRACT = audit.decision_contract(cfg.DecisionPolicy())


@register(
    "l1_runs_with_newest_config",
    query(
        "SELECT run_id, start_time, config_sha256, candidate_status, f1_macro FROM runs WHERE config_sha256 = "
        "(SELECT config_sha256 FROM runs ORDER BY start_time DESC, run_id LIMIT 1) ORDER BY start_time DESC, run_id",
        "runs",
    ),
)
def l1(spark, sf):
    return audit.runs_with_config(inputs.runs(spark, sf)).select(
        "run_id", "start_time", "config_sha256", "candidate_status", "f1_macro"
    )


@register(
    "l2_hash_tag_audit",
    query(
        " UNION ALL ".join(
            f"SELECT r.run_id, '{t}' AS tag, r.{t} AS recorded, m.{t} AS expected, CASE WHEN r.{t} IS NOT DISTINCT FROM m.{t} THEN 'OK' ELSE 'MISMATCH' END AS status "
            "FROM tagged_runs r JOIN (SELECT *, sha256('package-' || artifact_id) AS artifact_sha256 FROM manifests) m ON m.artifact_id = r.artifact_id"
            for t in audit.AUDITED_TAGS
        ),
        "tagged_runs",
        "manifests",
    ),
)
def l2(spark, sf):
    package = F.sha2(F.concat(F.lit("package-"), F.col("artifact_id")), 256)
    manifests = inputs.manifests(spark, sf).withColumn("artifact_sha256", package)
    return audit.audit_run_tags(inputs.tagged_runs(spark, sf), manifests)


_FILES_JSON = json.dumps(inputs.ARTIFACT_FILES, sort_keys=True, separators=(",", ":"))
_CONTRACT_JSON = json.dumps(CONTRACT, sort_keys=True, separators=(",", ":"))
_HASH_JSON = " || ',' || ".join(f"'\"{h}\":\"' || {h} || '\"'" for h in audit.MANIFEST_HASHES)


@register(
    "l3_artifact_fingerprint",
    query(
        "SELECT artifact_id, sha256('{\"artifact_type\":\"' || artifact_type || '\",\"decision_contract\":' || "
        + sql_text(_CONTRACT_JSON)
        + " || ',\"files\":' || "
        + sql_text(_FILES_JSON)
        + " || ',\"hashes\":{' || "
        + _HASH_JSON
        + " || '},\"schema_version\":\"' || schema_version || '\"}') AS artifact_sha256 FROM manifests",
        "manifests",
    ),
)
def l3(spark, sf):
    files = F.create_map(*[F.lit(x) for pair in inputs.ARTIFACT_FILES.items() for x in pair])
    return inputs.manifests(spark, sf).select(
        "artifact_id", audit.artifact_fingerprint(files, CONTRACT).alias("artifact_sha256")
    )


@register(
    "l4_find_decisions",
    query(
        """SELECT w.decision_id, t.decision_id IS NOT NULL AS found, t.artifact_id, t.created_at FROM
        (SELECT decision_id FROM traces UNION ALL SELECT sha256('absent-' || CAST(event_id AS VARCHAR)) FROM events) w
        LEFT JOIN traces t USING (decision_id)""",
        "traces",
    ),
)
def l4(spark, sf):
    traces = inputs.traces(spark, sf).select("decision_id", "artifact_id", "created_at")
    absent = F.sha2(F.concat(F.lit("absent-"), F.col("event_id").cast("string")), 256)
    unknown = inputs.table(spark, sf, "events").select(absent.alias("decision_id"))
    wanted = traces.select("decision_id").unionByName(unknown)
    return trace.find_decisions(traces, wanted)


_DIFFERENT = ", ".join(f"CASE WHEN t.{h} IS DISTINCT FROM m.{h} THEN '{h}' END" for h in cfg.CONTENT_HASHES)
define(
    "trace_audit",
    ("traces", "manifests"),
    f"""SELECT t.decision_id, t.artifact_id, m.artifact_id IS NOT NULL AS manifest_found,
      CASE WHEN m.artifact_id IS NULL THEN '' ELSE concat_ws(',', {_DIFFERENT}) END AS mismatches FROM traces t LEFT JOIN manifests m ON m.artifact_id = t.artifact_id""",
)
_STATUS = "CASE WHEN NOT manifest_found THEN 'manifest_missing' WHEN mismatches <> '' THEN 'mismatch' ELSE 'ok' END"


@register(
    "l5_trace_hash_audit",
    query(f"SELECT *, {_STATUS} AS audit_status FROM trace_audit", "trace_audit"),
)
def l5(spark, sf):
    rows = trace.audit_traces(inputs.traces(spark, sf), inputs.manifests(spark, sf))
    return rows.select(
        "decision_id", "artifact_id", "manifest_found", F.array_join("mismatches", ",").alias("mismatches"), "audit_status"
    )


@register(
    "l6_parse_artifact_names",
    query(
        r"""SELECT artifact_id, p[1] AS name, CAST(p[2] AS INTEGER) AS major, CAST(p[3] AS INTEGER) AS minor, CAST(p[4] AS INTEGER) AS patch,
          p[5] || '-' || p[6] AS timestamp FROM (SELECT artifact_id, [regexp_extract(artifact_id, '^(.+)-v([0-9]+)\.([0-9]+)\.([0-9]+)-([0-9]{8})-([0-9]{6})$', i) FOR i IN [1,2,3,4,5,6]] AS p FROM manifests)""".replace(
            "[regexp_extract(artifact_id, '^(.+)-v([0-9]+)\\.([0-9]+)\\.([0-9]+)-([0-9]{8})-([0-9]{6})$', i) FOR i IN [1,2,3,4,5,6]]",
            "["
            + ", ".join(
                rf"regexp_extract(artifact_id, '^(.+)-v([0-9]+)\.([0-9]+)\.([0-9]+)-([0-9]{{8}})-([0-9]{{6}})$', {k})"
                for k in range(1, 7)
            )
            + "]",
        ),
        "manifests",
    ),
)
def l6(spark, sf):
    rows = audit.parse_artifact_names(inputs.manifests(spark, sf))
    return rows.select("artifact_id", "name", "major", "minor", "patch", "timestamp")


@register(
    "l6_latest_artifacts",
    query(
        """SELECT 'decider' AS name, 1 AS major, s_nationkey AS minor, artifact_id, CAST(s_suppkey % 10 AS INTEGER) AS patch,
          '20260101-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS timestamp, count(*) OVER (PARTITION BY s_nationkey) AS artifact_count
        FROM supplier JOIN manifests ON artifact_no = s_suppkey QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 10 DESC, s_suppkey DESC) = 1""",
        "manifests",
    ),
)
def l6_latest(spark, sf):
    return audit.latest_artifacts(audit.parse_artifact_names(inputs.manifests(spark, sf)))


@register(
    "l7_resolve_patches",
    query(
        """SELECT build_id, minor, timestamp, CAST(sum(changed) OVER (PARTITION BY minor ORDER BY timestamp, build_id) AS INTEGER) AS patch FROM
        (SELECT *, CASE WHEN lag(model_sha256) OVER w <> model_sha256 OR lag(config_sha256) OVER w <> config_sha256 THEN 1 ELSE 0 END AS changed
        FROM builds WINDOW w AS (PARTITION BY minor ORDER BY timestamp, build_id))""",
        "builds",
    ),
)
def l7(spark, sf):
    return audit.resolve_patches(inputs.builds(spark, sf)).select("build_id", "minor", "timestamp", "patch")


def _blank(names) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({n}, '') = '' THEN '{n}' END" for n in names) + ")"


_CHECK_SQL = ", ".join(
    f"CASE WHEN coalesce((SELECT last(status ORDER BY position) FROM gate_checks k WHERE k.gate_run = r.gate_run AND check_name = '{c}'), '') <> 'passed' THEN '{c}' END"
    for c in cfg.REQUIRED_GATE_CHECKS
)


@register(
    "l8_gate_evidence",
    query(
        f"""SELECT *, first_problem IS NULL AS evidence_ok FROM (SELECT gate_run, missing_fields, missing_artifact_fields, missing_hashes, failed_checks,
          CASE WHEN missing_fields <> '' THEN 'missing_report_fields' WHEN status <> 'passed' THEN 'status_not_passed' WHEN missing_artifact_fields <> '' THEN 'missing_artifact_fields'
            WHEN failed_checks <> '' THEN 'missing_or_failed_checks' WHEN missing_hashes <> '' THEN 'missing_manifest_hashes' END AS first_problem
        FROM (SELECT gate_run, status, {_blank(audit.REPORT_FIELDS)} AS missing_fields, {_blank(audit.ARTIFACT_FIELDS)} AS missing_artifact_fields,
          {_blank(cfg.CONTENT_HASHES)} AS missing_hashes, concat_ws(',', {_CHECK_SQL}) AS failed_checks FROM gate_reports r))""",
        "gate_reports",
        "gate_checks",
    ),
)
def l8(spark, sf):
    rows = audit.audit_gates(inputs.gate_reports(spark, sf), inputs.gate_checks(spark, sf))
    lists = ("missing_fields", "missing_artifact_fields", "missing_hashes", "failed_checks")
    return rows.select("gate_run", *[F.array_join(c, ",").alias(c) for c in lists], "first_problem", "evidence_ok")
