"""Exact percentiles by selection on bit patterns."""

from __future__ import annotations

import math
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftline.operators import evaluation

NAN, INF = float("nan"), float("inf")
QUANTILES = {"least": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "most": 1.0}


def pattern(x: float) -> int:
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_patterns_of_doubles(spark):
    rnd = random.Random(8)
    values = [0.0, -0.0, INF, -INF, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.7976931348623157e308, 1.0, -1.0]
    for k in range(-1074, 1024, 3):
        values += [2.0**k, -math.nextafter(2.0**k, INF), math.nextafter(2.0**k, 0)]
    values += [v for v in (struct.unpack("<d", rnd.randbytes(8))[0] for _ in range(4_000)) if v == v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", evaluation.ordered_bits(F.col("v")).alias("b")).collect()
    assert all(r.b == pattern(r.v) for r in rows) and len(rows) == len(values)
    nan = spark.createDataFrame([(NAN,)], "v double").select(evaluation.ordered_bits(F.col("v")).alias("b")).first()
    assert nan.b > pattern(INF)


def plain(rows):
    groups = defaultdict(list)
    for g, h, v in rows:
        if v is not None:
            groups[g, h].append(v)
    out = {}
    for key, values in groups.items():
        values.sort(key=lambda v: (v != v, v))
        for name, q in QUANTILES.items():
            out[(*key, name)] = values[max(math.ceil(q * len(values)), 1) - 1]
    return out


def same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_selection_equals_sorting(spark, broadcast):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, 1, None]), rnd.choice([None, rnd.gauss(0, 1e3), rnd.choice([5.0, -5.0, 0.0, NAN, INF, -INF, 1e-310])])) for _ in range(4_000)]
    rows += [("lonely", 7, 3.5), ("nothing", 7, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    got = evaluation.nearest_rank_percentiles(frame, "v", QUANTILES, ("g", "h"), broadcast_targets=broadcast).collect()
    want = plain(rows)
    assert {(r.g, r.h, r.quantile) for r in got} == set(want) and len(got) == len(want)
    assert all(same(r.value, want[r.g, r.h, r.quantile]) for r in got)


def test_many_values_close_together_in_one_group(spark):
    """100,000 distinct values within a ten-thousandth: the last bits decide, and no task sees them all sorted."""
    values = [1.0 + k * 1e-9 for k in random.Random(6).sample(range(100_000), 100_000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(8)
    got = {r.quantile: r.value for r in evaluation.nearest_rank_percentiles(frame, "v", QUANTILES).collect()}
    ordered = sorted(values)
    assert got == {name: ordered[max(math.ceil(q * len(ordered)), 1) - 1] for name, q in QUANTILES.items()}
    lowest = [math.nextafter(1.0, 2.0)] * 70 + [1.0] * 29
    frame = spark.createDataFrame([(v,) for v in lowest], "v double")
    got = {r.quantile: r.value for r in evaluation.nearest_rank_percentiles(frame, "v", {"a": 0.29, "b": 0.3}).collect()}
    assert got == {"a": 1.0, "b": lowest[0]}


def test_empty_samples(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert evaluation.nearest_rank_percentiles(none, "v", QUANTILES, ("g",)).collect() == []
    groups = spark.createDataFrame([(None, 2.0), (None, 4.0), ("x", None)], "g string, v double")
    rows = {r.g: r for r in evaluation.latency_summary(groups, "v", ("g",)).collect()}
    assert rows[None].p50_ms == 2.0 and rows[None].max_ms == 4.0 and rows["x"].sample_count == 0
