"""Adapters: the domain tables of the library, derived from the given parquet tables.

Column rules that both engines understand are kept as SQL text and used by the Spark
adapters here as well as by the oracle. Each rule covers the whole input table.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.scoring import LinearModel

# Coefficients of the fixed scoring model: one row per label, features in library order.
MODEL = LinearModel(
    intercepts=(-0.6, 0.2, -0.4),
    weights=(
        (0.012, 0.3, 0.006, 0.1, 0.5, 0.2, 0.1, 1.4, -0.9, 0.3, 1.6, -0.2),
        (-0.015, -0.2, -0.004, 0.2, -0.1, 0.3, 0.1, -1.1, 1.9, -0.4, -0.9, -0.7),
        (0.009, -0.1, 0.008, 0.1, -0.2, -0.1, 0.4, 0.2, -0.6, 1.2, -0.8, 1.5),
    ),
)

SIMILARITY_THRESHOLD = 0.35

LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'info' "
    "WHEN 'purchase' THEN 'WARNING' ELSE 'WARN' END"
)
SERVICE = (
    "CASE user_id % 4 WHEN 0 THEN 'payments' WHEN 1 THEN 'Web' WHEN 2 THEN 'api' ELSE 'storage' END"
)
MESSAGE = (
    "CASE event_id % 6 WHEN 0 THEN 'db timeout after retries' WHEN 1 THEN 'High latency detected' "
    "WHEN 2 THEN 'request completed successfully' WHEN 3 THEN 'queue depth alert' "
    "WHEN 4 THEN 'shard lag on reads' ELSE 'connection pool exhausted' END"
)
CPU = (
    "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 19 = 0 THEN ' cpu 92%' "
    "ELSE ' cpu ' || CAST(CAST(floor(value) AS BIGINT) AS STRING) END"
)
MEMORY = "CASE WHEN event_id % 5 = 0 THEN '' ELSE ' memory ' || k END"
ACTION = (
    "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN ' action restart' "
    "WHEN event_type = 'error' THEN ' action open_ticket' "
    "WHEN event_type IN ('click', 'view') THEN ' action ignore' ELSE ' action scale_up' END"
)
RAW_LOG = (
    f"CASE WHEN event_id % 17 = 0 THEN stamp || ' ERROR' ELSE stamp || ' ' || ({LEVEL}) || ' ' || "
    f"({SERVICE}) || ' ' || ({MESSAGE}) || ({CPU}) || ({MEMORY}) || ({ACTION}) END"
)
PADDED_LOG = (
    "CASE WHEN line_id % 23 = 0 THEN '   ' WHEN line_id % 3 = 0 THEN '  ' || raw_log "
    "WHEN line_id % 3 = 1 THEN raw_log || '  ' ELSE raw_log END"
)
RESPONSE = """
CASE event_id % 6
WHEN 0 THEN 'no structured answer for line ' || CAST(event_id AS STRING)
WHEN 1 THEN 'Analysis: {"summary": "line ' || CAST(event_id AS STRING) || '", "root_cause": "database", '
  || '"recommended_action": "open_ticket", "confidence": ' || CAST((event_id % 100) / 100e0 AS STRING)
  || ', "reason": "pattern", "missing_context": ["owner", "deploy"]} end'
WHEN 2 THEN '{"recommended_action": "kubectl_delete", "confidence": 0.95, "summary": null}'
WHEN 3 THEN '{"recommended_action": "ignore", "confidence": 1.7, "root_cause": "unknown"}'
WHEN 4 THEN '{"recommended_action": "suggest_scale_up", "confidence": "high"}'
ELSE '{"recommended_action": "open_ticket", "confidence": 0.9' END
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, raw_log and the event's user, one line per event."""
    events = table(spark, sf_dir, "events").withColumns(
        {
            "stamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            "k": F.get_json_object("props", "$.k"),
        }
    )
    return events.select(
        F.col("event_id").alias("line_id"), F.expr(RAW_LOG).alias("raw_log")
    )


def padded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with white space around them and some blank lines."""
    return log_lines(spark, sf_dir).select("line_id", F.expr(PADDED_LOG).alias("raw_log"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, raw_text: one model response per event."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("line_id"), F.expr(RESPONSE).alias("raw_text"))

# Artifact manifests, one per supplier. SHA( stands for each engine's sha256 function.
MANIFESTS = """
SELECT artifact_id, s_suppkey AS artifact_no, '/artifacts/' || artifact_id AS artifact_path, 'run-' || lpad(CAST(s_suppkey AS STRING), 8, '0') AS run_id,
  substr(SHA('git-' || CAST(s_suppkey % 7 AS STRING)), 1, 40) AS git_sha,
  'v1' AS schema_version, 'decision_engine' AS artifact_type,
  SHA('model-' || CAST(s_suppkey % 13 AS STRING)) AS model_sha256,
  SHA('vectorizer-' || CAST(s_suppkey % 5 AS STRING)) AS vectorizer_sha256,
  SHA('actions-' || CAST(s_nationkey % 2 AS STRING)) AS known_actions_sha256,
  SHA('config-' || CAST(s_suppkey % 3 AS STRING)) AS config_sha256,
  SHA('data-' || CAST(s_nationkey AS STRING)) AS training_data_sha256,
  SHA('training-' || CAST(s_suppkey % 3 AS STRING)) AS training_config_sha256,
  SHA('policy-' || CAST(s_suppkey % 2 AS STRING)) AS policy_sha256
FROM (SELECT *, 'decider-v1.' || CAST(s_nationkey AS STRING) || '.' || CAST(s_suppkey % 10 AS STRING)
  || '-20260101-' || lpad(CAST(s_suppkey AS STRING), 6, '0') AS artifact_id FROM supplier)
"""


def sha_calls(sql: str) -> str:
    """Spark form of the SHA(...) calls in shared SQL text."""
    return re.sub(r"SHA\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"sha2(\1, 256)", sql)


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artifact manifest per supplier."""
    sql = sha_calls(MANIFESTS).replace("FROM supplier", "FROM {supplier}")
    return spark.sql(sql, supplier=table(spark, sf_dir, "supplier"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a query."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def incident_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a past incident; a query is compared with all others."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("incident_id"),
        F.expr("'incident ' || CAST(vec_id AS STRING)").alias("log"),
        F.expr("'cause ' || CAST(label AS STRING)").alias("known_root_cause"),
        F.expr(KNOWN_ACTION).alias("known_action"),
        "embedding",
    )


KNOWN_ACTION = (
    "CASE label % 3 WHEN 0 THEN 'open_ticket' WHEN 1 THEN 'ignore' ELSE 'suggest_scale_up' END"
)


def with_query_key(lines: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie each line to one query vector; many lines share a vector."""
    size = table(spark, sf_dir, "embeddings").count()
    return lines.withColumn("query_id", F.col("line_id") % size)

# Experiment runs, one per part; five consecutive parts form a comparison group.
# SHA( stands for each engine's sha256 function.
RUNS = """
SELECT run_id, 'run ' || CAST(i AS STRING) || ' of ' || gid AS run_name,
  CASE WHEN p % 51 = 0 THEN 'FAILED' ELSE 'FINISHED' END AS status,
  '2026-01-' || lpad(CAST(1 + g % 28 AS STRING), 2, '0') || ' 00:00:0' || CAST(i AS STRING) AS start_time,
  CASE WHEN g % 23 = 0 THEN 'unknown' ELSE gid END AS comparison_group_id,
  'v' || CAST(i AS STRING) AS variant_name, CASE WHEN i = 0 THEN 'baseline' ELSE 'challenger' END AS variant_type,
  p_type AS model_family,
  CASE WHEN g % 9 = 0 AND i = 0 THEN 'ablation' ELSE 'model_family' END AS comparison_type,
  CASE WHEN g % 26 = 0 AND i = 2 THEN 'vectorizer' WHEN g % 14 = 0 THEN 'tfidf_ngram_range'
    WHEN g % 15 = 0 THEN 'random_state' ELSE 'model_family' END AS changed_variable,
  'raw_data, train_split,test_split,policy' || CASE WHEN g % 17 = 0 THEN ',hardware' ELSE '' END AS controlled_variables,
  CASE WHEN g % 5 = 0 AND i = 4 THEN NULL WHEN g % 7 = 0 AND i = 1 THEN SHA('data-x') ELSE SHA('data-' || gid) END AS training_data_sha256,
  SHA('train-' || gid) AS train_split_sha256, SHA('test-' || gid) AS test_split_sha256,
  SHA('split-' || gid) AS split_sha256, SHA('features-' || gid) AS feature_pipeline_sha256,
  CASE WHEN g % 13 = 0 AND i > 0 THEN NULL ELSE SHA('policy-' || gid) END AS policy_sha256,
  SHA('evaluation-' || gid) AS evaluation_code_sha256,
  CASE WHEN p % 37 = 0 THEN '' ELSE SHA('experiment-' || CAST(g % 40 AS STRING)) END AS experiment_config_sha256,
  'experiments/' || CAST(g % 40 AS STRING) || '.yaml' AS experiment_config_path,
  'manual_and_text' AS feature_pipeline_name, 'TfidfVectorizer' AS vectorizer_name, 'tournament' AS experiment_name,
  CASE WHEN p % 29 = 0 THEN NULL ELSE (70 + (p_size * 7 + p) % 31) / 100e0 END AS f1_macro,
  (60 + (p_size * 5 + p) % 37) / 100e0 AS combined_accuracy,
  (60 + (p_size * 3 + p) % 41) / 100e0 AS combined_weakest_class_recall,
  (p % 26) / 100e0 AS low_confidence_rate, (p * 7 % 60) / 100e0 AS approval_required_rate,
  round((p_retailprice - 880e0) * 2e0, 4) AS offline_decision_latency_p95_ms,
  CASE p % 8 WHEN 0 THEN 'selected' WHEN 1 THEN 'rejected' WHEN 2 THEN 'superseded' WHEN 3 THEN NULL ELSE 'not_evaluated' END AS candidate_status,
  CASE WHEN (i = 0 AND g % 4 <> 0) OR (i = 1 AND g % 6 = 0) THEN 'true' ELSE 'false' END AS current_candidate,
  CASE WHEN i < 2 THEN 'true' ELSE 'false' END AS candidate,
  CASE WHEN p % 9 = 1 THEN NULL ELSE 'reason ' || CAST(p % 5 AS STRING) END AS promotion_reason,
  CASE WHEN p % 27 = 0 THEN NULL ELSE 'owner ' || CAST(p % 3 AS STRING) END AS run_owner,
  CASE WHEN p % 38 = 0 THEN NULL WHEN p % 19 = 0 THEN '500' ELSE '1000' END AS model_max_iter,
  CASE WHEN p % 21 = 0 THEN '7' ELSE '42' END AS random_state,
  CASE WHEN g % 6 = 0 THEN '[1, 2]' ELSE '[1, 1]' END AS ngram_range,
  CASE WHEN p % 33 = 0 THEN '5000' END AS max_features,
  SHA('config-' || CAST(p % 3 AS STRING)) AS config_sha256
FROM (SELECT *, p_partkey AS p, CAST(floor(p_partkey / 5) AS BIGINT) AS g, p_partkey % 5 AS i,
  'run-' || lpad(CAST(p_partkey AS STRING), 8, '0') AS run_id,
  'grp-' || lpad(CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS STRING), 6, '0') AS gid FROM part)
"""

BASELINES = """
SELECT comparison_group_id, 'run-' || lpad(CAST(g * 5 + CASE WHEN g % 10 = 0 THEN 2 ELSE 0 END AS STRING), 8, '0') AS baseline_run_id,
  g % 10 = 0 AS allow_override, CASE WHEN g % 20 = 0 THEN 'agreed by the owner' END AS override_reason
FROM (SELECT comparison_group_id, CAST(substr(comparison_group_id, 5) AS BIGINT) AS g FROM runs
  WHERE comparison_group_id <> 'unknown' GROUP BY comparison_group_id)
"""

ARTIFACTS = """
SELECT run_id, 'decision_artifact/' || run_id || '/manifest.json' AS path FROM runs
UNION ALL SELECT run_id, 'promotion_report.md' AS path FROM runs WHERE CAST(substr(run_id, 5) AS BIGINT) % 12 <> 0
UNION ALL SELECT run_id, 'notes/promotion_report.md.bak' AS path FROM runs
"""

PLAN = """
SELECT g AS position, 'plan-' || CAST(g AS STRING) AS label, 'parameter_' || CAST(g % 4 AS STRING) AS changed_parameter,
  CASE WHEN g % 40 = 0 THEN '<COMPARISON_GROUP_ID>' WHEN g % 41 = 0 THEN 'grp-none' ELSE comparison_group_id END AS comparison_group_id
FROM (SELECT comparison_group_id, CAST(substr(comparison_group_id, 5) AS BIGINT) AS g FROM runs
  WHERE comparison_group_id <> 'unknown' GROUP BY comparison_group_id)
"""

PARAMS = ("model_family", "model_max_iter", "feature_pipeline_name", "feature_pipeline_sha256", "variant_name",
          "experiment_config_sha256", "random_state", "ngram_range", "max_features")
METRICS = ("f1_macro", "combined_accuracy", "combined_weakest_class_recall", "low_confidence_rate",
           "approval_required_rate", "offline_decision_latency_p95_ms")
TAGS = ("candidate_status", "candidate", "current_candidate", "promotion_reason", "run_owner", "comparison_group_id",
        "variant_name", "variant_type", "comparison_type", "changed_variable", "controlled_variables", "training_data_sha256",
        "train_split_sha256", "test_split_sha256", "split_sha256", "feature_pipeline_name", "feature_pipeline_sha256",
        "policy_sha256", "evaluation_code_sha256", "experiment_config_sha256", "experiment_config_path", "vectorizer_name",
        "model_family", "experiment_name")


def _map(names):
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    return F.expr(f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)")


def wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One experiment run per part, with wide columns."""
    sql = sha_calls(RUNS).replace("FROM part)", "FROM {part})")
    return spark.sql(sql, part=table(spark, sf_dir, "part"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs with their three open maps beside the wide columns."""
    maps = {"params": _map(PARAMS), "metrics": _map(METRICS), "tags": _map(TAGS)}
    return wide_runs(spark, sf_dir).withColumns(maps)


def _over_runs(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    wide = wide_runs(spark, sf_dir)
    return spark.sql(re.sub(r"FROM runs\b", "FROM {runs}", sql), runs=wide)


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_runs(spark, sf_dir, BASELINES)


def run_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_runs(spark, sf_dir, ARTIFACTS)


def tuning_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_runs(spark, sf_dir, PLAN)


def run_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the runs: run_id, kind, key, value. Every third group uses the older
    name of the group tag, and a missing metric is stored as NaN."""
    info = ("run_name", "status", "start_time")
    older = "CAST(substr(run_id, 5) AS BIGINT) % 3 = 0"

    def entry(kind: str, n: str) -> str:
        key = f"'{n}'"
        if n == "comparison_group_id":
            key = f"if({older}, 'fair_comparison_group_id', {key})"
        value = f"CAST({n} AS STRING)"
        if kind == "metrics":
            value = f"coalesce({value}, 'NaN')"
        return f"struct('{kind}' AS kind, {key} AS key, {value} AS value)"

    kinds = {"info": info, "tags": TAGS, "metrics": METRICS, "params": PARAMS}
    rows = ", ".join(entry(kind, n) for kind, names in kinds.items() for n in names)
    long = wide_runs(spark, sf_dir).selectExpr("run_id", f"inline(array({rows}))")
    return long.filter("value IS NOT NULL")

# Traces: one per event, made by the artifact with the number user_id % artifact count.
TRACES = """
SELECT SHA('decision-' || CAST(event_id AS STRING)) AS decision_id, '2026-01-01T00:00:00Z' AS created_at,
  CASE WHEN event_id % 37 = 0 THEN 'decider-unknown' ELSE m.artifact_id END AS artifact_id,
  CASE WHEN event_id % 31 = 0 THEN 'altered' ELSE m.model_sha256 END AS model_sha256, m.vectorizer_sha256,
  m.known_actions_sha256, CASE WHEN event_id % 43 = 0 THEN NULL ELSE m.config_sha256 END AS config_sha256, m.training_data_sha256
FROM (SELECT *, user_id % (SELECT count(*) FROM manifests) AS wanted_no FROM events) JOIN manifests m ON m.artifact_no = wanted_no
"""

# Audited runs: one per customer.
TAGGED_RUNS = """
SELECT 'run-c' || CAST(c_custkey AS STRING) AS run_id, m.artifact_id,
  CASE WHEN c_custkey % 17 = 0 THEN 'unknown' ELSE m.git_sha END AS git_sha, m.config_sha256, m.training_config_sha256,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE m.policy_sha256 END AS policy_sha256, m.training_data_sha256,
  m.model_sha256, m.vectorizer_sha256, m.known_actions_sha256,
  CASE WHEN c_custkey % 11 = 0 THEN 'stale' ELSE SHA('package-' || m.artifact_id) END AS artifact_sha256
FROM (SELECT *, c_custkey % (SELECT count(*) FROM manifests) AS wanted_no FROM customer) JOIN manifests m ON m.artifact_no = wanted_no
"""

# Builds: one per order; the version line 1.0 gets a large share of them.
BUILDS = """
SELECT o_orderkey AS build_id, 'decider' AS name, 1 AS major, CAST(greatest(o_custkey % 9 - 3, 0) AS INTEGER) AS minor,
  DAY(o_orderdate) || '-' || lpad(CAST(o_orderkey % 240000 AS STRING), 6, '0') AS timestamp,
  SHA('model-' || o_orderstatus) AS model_sha256, SHA('vectorizer') AS vectorizer_sha256, SHA('actions') AS known_actions_sha256,
  SHA('config-' || substr(o_orderpriority, 1, 1)) AS config_sha256, SHA('data') AS training_data_sha256 FROM orders
"""

GATE_CHECKS = """
SELECT o_custkey AS gate_run, CASE o_orderkey % 7 WHEN 0 THEN 'policy_tests' WHEN 1 THEN 'artifact_tests' WHEN 2 THEN 'quality_gate_report_tests'
  WHEN 3 THEN 'prediction_contract_tests' WHEN 4 THEN 'smoke_prediction' WHEN 5 THEN 'traceability_integration' ELSE 'deterministic_test_suite' END AS check_name,
  CASE WHEN o_orderstatus = 'P' AND o_totalprice > 400000e0 THEN 'failed' ELSE 'passed' END AS status, o_orderkey AS position FROM orders
"""

GATE_REPORTS = """
SELECT c_custkey AS gate_run, 'v1' AS report_version, '2026-01-01' AS generated_at, 'run-c' || CAST(c_custkey AS STRING) AS run_id,
  CASE WHEN c_custkey % 19 = 0 THEN '' ELSE m.git_sha END AS git_sha, CASE WHEN c_custkey % 23 = 0 THEN 'failed' ELSE 'passed' END AS status,
  m.artifact_id, '1.0' AS model_version, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE '2026-01-01' END AS created_at,
  m.artifact_path || '/manifest.json' AS manifest_path, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE m.model_sha256 END AS model_sha256,
  m.vectorizer_sha256, m.known_actions_sha256, m.config_sha256, m.training_data_sha256
FROM (SELECT *, c_custkey % (SELECT count(*) FROM manifests) AS wanted_no FROM customer) JOIN manifests m ON m.artifact_no = wanted_no
"""

ARTIFACT_FILES = {"model": "model.bin", "vectorizer": "vectorizer.bin", "known_actions": "known_actions.json"}


def _over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Shared SQL text over given tables and the manifests."""
    text = sha_calls(sql).replace("DAY(o_orderdate)", "date_format(o_orderdate, 'yyyyMMdd')")
    if "manifests" in names:
        # One manifest per supplier; the count comes from the file footer.
        size = table(spark, sf_dir, "supplier").count()
        text = text.replace("(SELECT count(*) FROM manifests)", str(size))
    frames = {}
    for name in names:
        text = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        frames[name] = manifests(spark, sf_dir) if name == "manifests" else table(spark, sf_dir, name)
    return spark.sql(text, **frames)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, TRACES, "events", "manifests")


def tagged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, TAGGED_RUNS, "customer", "manifests")


def builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, BUILDS, "orders")


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, GATE_CHECKS, "orders").withColumnRenamed("check_name", "check")


def gate_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, GATE_REPORTS, "customer", "manifests")
