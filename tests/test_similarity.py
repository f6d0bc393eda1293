"""Exact search through blocks: equal to brute force, and opening few blocks where vectors form groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import similarity


def frames(spark, data, every):
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    memory = spark.createDataFrame(rows, "incident_id bigint, embedding array<double>").repartition(4)
    return memory.filter(F.col("incident_id") % every == 0).withColumnRenamed("incident_id", "query_id"), memory


def brute(data, queries, k):
    norms = np.sqrt((data * data).sum(axis=1))
    units = np.divide(data, norms[:, None], out=np.zeros_like(data), where=norms[:, None] > 0)
    out = {}
    for q in queries:
        shown = np.round(units @ units[q], 4)
        shown[q] = -np.inf
        out[q] = np.lexsort((np.arange(len(data)), -shown))[:k].tolist()
    return out


def clustered(n, seed=3):
    """A third of the vectors in one tight group, the rest in others, some zero and some equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    which = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 20, n))
    data = centres[which] + 0.05 * rng.normal(size=(n, 16))
    data[7:n:400] = 0.0
    data[30:60] = data[30]
    return data


@pytest.mark.parametrize("block_rows", [60, 500, 20_000])
@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_search_equals_brute_force(spark, kind, block_rows):
    data = clustered(1_500) if kind == "clustered" else np.random.default_rng(1).normal(size=(1_500, 16))
    queries, memory = frames(spark, data, 10)
    got: dict[int, list] = {}
    for r in sorted(similarity.nearest_incidents(queries, memory, 5, True, block_rows).collect(), key=lambda r: (r.query_id, r._place)):
        got.setdefault(r.query_id, []).append(r.incident_id)
    assert got == brute(data, range(0, 1_500, 10), 5)


def test_few_blocks_are_opened_in_clusters(spark):
    data = clustered(6_000)
    queries, memory = frames(spark, data, 20)
    context, block_rows = spark.sparkContext, 100
    centroids = context.broadcast(similarity._centroids(memory, 60))
    placed = similarity._placed(memory, centroids)
    stats = [tuple(r) for r in placed.groupBy("length", "block").agg(F.count("*"), F.max("angle")).collect()]
    blocks = context.broadcast(similarity.Blocks(stats))
    close = queries.withColumn("kth", F.lit(0.97))
    opened = sum(similarity._visits(close, centroids, blocks, 3, first).count() for first in (True, False))
    # Far fewer than a visit of every query to every block of `block_rows` vectors.
    assert 0 < opened < 0.4 * queries.count() * len(data) / block_rows


def test_repeated_incident_ids_fail(spark):
    memory = spark.createDataFrame([(1, "l", "c", "ignore", [1.0, 0.0])] * 2, "incident_id bigint, log string, known_root_cause string, known_action string, embedding array<double>")
    queries = spark.createDataFrame([(5, [1.0, 0.5])], "query_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="occurs twice"):
        similarity.top_incidents(queries, memory).collect()


def test_memory_of_a_task_is_bounded():
    """Matrices and handed batches keep their size however many vectors, queries and blocks there are."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)

    def side(name, n):
        return pd.DataFrame({name: np.arange(n), "embedding": list(rng.normal(size=(n, 8)))})

    queries, memory = side("query_id", 2_000), side("incident_id", 6_000)
    tracemalloc.start()
    found = similarity._best_in_block(queries, memory, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 6_000 and peak < 60 << 20


def test_visits_are_handed_on_in_small_batches():
    """All queries visit all blocks but their nearest; no batch holds more than the stated rows."""
    from types import SimpleNamespace

    import pyarrow as pa

    data = np.random.default_rng(2).normal(size=(2_000, 8))
    centroids = similarity.Centroids(data[:50].tolist())
    blocks = similarity.Blocks([(8, k, 40, 1.5) for k in range(50)])
    frame = SimpleNamespace(select=lambda *names: SimpleNamespace(mapInArrow=lambda run, schema: run))
    run = similarity._visits(frame, SimpleNamespace(value=centroids), SimpleNamespace(value=blocks), 3, False)
    none = pa.array([None] * len(data), pa.float64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(data))), pa.array(data.tolist()), none], names=["query_id", "embedding", "kth"])
    sizes = [b.num_rows for b in run([batch])]
    assert sum(sizes) == 2_000 * 49 and max(sizes) <= similarity._HANDED
