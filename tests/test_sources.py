"""Files, the trace table and the stream."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from catalog.inputs import MODEL
from siftline import config as cfg
from siftline.operators import models, trace
from siftline.plans import scoring as plans
from siftline.sources import logs, runs, traces
from siftline.streaming import decisions as streaming

RULES = cfg.DecisionPolicy()
LINES = ["2026-05-03 09:12:11 ERROR payments db timeout cpu 93 memory 84", "", "  broken line ", "d t INFO web fine cpu 5 memory 6"]


def manifest(spark):
    return spark.createDataFrame([Row(**{f: f for f in trace.MANIFEST_FIELDS})])


def test_files_to_trace_table_and_back(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(LINES), encoding="utf-8")
    lines = logs.read_log_lines(spark, str(tmp_path / "a.txt"))
    assert sorted(r.raw_log for r in lines.collect()) == sorted(line.strip() for line in LINES if line.strip())
    with pytest.raises(Exception):
        logs.read_log_lines(spark, str(tmp_path / "absent.txt")).count()
    decided = plans.decide_and_trace(lines, MODEL, RULES, manifest(spark), created_at=F.lit("2026-01-01T00:00:00Z"))
    path = str(tmp_path / "traces")
    traces.append_traces(decided, path)
    traces.append_traces(decided.filter("status = 'error'"), path)
    stored = traces.read_traces(spark, path)
    assert stored.count() == 4
    wanted = stored.first().decision_id
    found = traces.read_decision(spark, path, wanted)
    assert found.first().decision_id == wanted
    assert "PartitionFilters: [isnotnull(id_prefix" in spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    with pytest.raises(Exception, match="without trace"):
        traces.append_traces(decided.withColumn("trace", F.when(F.col("status") == "ok", F.col("trace"))), path)


def ids(frame):
    return sorted((r.raw_log, r.line_id) for r in frame.collect())


def test_line_ids_do_not_depend_on_the_read(spark, tmp_path):
    """Equal lines differ, two reads agree, and so do reads in splits of a few bytes."""
    for name, n in (("a.txt", 40), ("b.txt", 7)):
        (tmp_path / name).write_text("\n".join([*LINES, "same line here again"] * n) + "\n", encoding="utf-8")
    whole = ids(logs.read_log_lines(spark, str(tmp_path)))
    assert len(whole) == len({i for _, i in whole}) == 47 * 4
    places = {i.rsplit("/", 1)[1] for text, i in whole if text == "same line here again"}
    assert places == {f"{name}:{5 * k}" for name, n in (("a.txt", 40), ("b.txt", 7)) for k in range(1, n + 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("97b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            cut = logs.read_log_lines(spark, str(tmp_path))
            assert ids(cut) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_appends_and_replays_leave_each_decision_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "traces")
    source.mkdir()
    (source / "a.txt").write_text("\n".join([LINES[0], LINES[0], "  broken line ", LINES[0]]), encoding="utf-8")

    def decided(day):
        return plans.decide_and_trace(logs.read_log_lines(spark, str(source)), MODEL, RULES, manifest(spark), created_at=F.lit(f"2026-01-0{day}T00:00:00Z"))

    for day in (1, 2):  # the job again, a day later
        traces.append_traces(decided(day), path)
    assert traces.read_traces(spark, path).count() == 4
    traces.append_traces(decided(3).filter("status = 'error'"), path, batch="some of them")
    stored = traces.read_traces(spark, path)
    assert stored.count() == 5 and traces.once_each(stored).count() == 4
    wanted = {r.decision_id: r.created_at for r in traces.once_each(stored).collect()}
    for decision in wanted:
        assert [r.created_at for r in traces.read_decision(spark, path, decision).collect()] == [wanted[decision]]
    # The stream has the ids of the batch job; a micro-batch that comes again replaces itself.
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    placed = logs.stream_placed_lines(spark, str(source))
    streaming.start_decisions(placed, MODEL, RULES, manifest(spark), out, state, available_now=True).awaitTermination(120)
    replayed = logs.with_place(spark.read.text(str(source)))
    streaming.decide_batch(replayed, 0, MODEL, RULES, manifest(spark), out)
    (source / "b.txt").write_text(LINES[0], encoding="utf-8")
    streaming.start_decisions(placed, MODEL, RULES, manifest(spark), out, state, available_now=True).awaitTermination(120)
    got = [r.decision_id for r in traces.read_traces(spark, out).collect()]
    assert len(got) == len(set(got)) == 5 and set(wanted) < set(got)


def test_stream_gives_the_batch_decisions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(LINES), encoding="utf-8")
    lines = logs.stream_log_lines(spark, str(source))
    decided = streaming.decide_stream(lines, MODEL, RULES, manifest(spark))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streaming.start_trace_sink(decided, out, state, available_now=True).awaitTermination(120)
    (source / "b.txt").write_text(LINES[0], encoding="utf-8")
    streaming.start_trace_sink(decided, out, state, available_now=True).awaitTermination(120)
    got = sorted((r.raw_log, r.predicted_action, r.confidence) for r in
                 spark.read.parquet(out).select("request.raw_log", "decision.predicted_action", "decision.confidence").collect())
    batch = logs.read_log_lines(spark, str(source))
    want = sorted((r.raw_log, r.predicted_action, r.confidence) for r in plans.decide_lines(batch, MODEL, RULES).collect())
    assert got == want and len(got) == 4


def test_event_log_appends(spark, tmp_path):
    report = spark.createDataFrame([("g", "selected", "r1", "b"), ("h", "no_candidate_selected", None, "b")],
                                   "comparison_group_id string, selection_status string, selected_run_id string, baseline_run_id string")
    for stamp in ("2026-01-01", "2026-01-02"):
        runs.append_events(runs.selection_events(report, stamp, "p", "v1"), str(tmp_path / "events"))
    stored = spark.read.json(str(tmp_path / "events"))
    assert sorted((r.scope, r.generated_at) for r in stored.collect()) == [("g", "2026-01-01"), ("g", "2026-01-02")]


def test_models_learn_the_labels(spark):
    rows = spark.range(120).select(
        F.col("id").alias("line_id"),
        (F.col("id") % 3).cast("int").alias("label"),
        F.element_at(F.array(F.lit("db timeout"), F.lit("all fine"), F.lit("high latency")), (F.col("id") % 3 + 1).cast("int")).alias("message"),
        F.when(F.col("id") % 5 < 3, "train").otherwise("test").alias("split"),
        *[F.lit(0).alias(f) for f in cfg.FEATURE_NAMES],
    )
    settings = cfg.TrainingSettings(max_iter=50)
    fitted, table = models.train_variants(rows, settings=settings)
    out = {r.variant_name: r for r in table.collect()}
    assert len(fitted) == 2 and all(r.combined_accuracy == 1.0 and r.f1_macro == 1.0 for r in out.values())
    assert {r.comparison_group_id for r in out.values()} == {"model-family"} and all(r.decision_count == 48 for r in out.values())
