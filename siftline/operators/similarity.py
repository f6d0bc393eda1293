"""Top-k similar incidents and the vote over them.

The search is exact and opens only blocks that can matter. Memory vectors belong to the nearest
of some centroids; a block is a centroid's vectors with their largest angle to it, so the angle from
a query to the centroid, less that radius, bounds every angle to the block. A query first reads
its nearest blocks, and then those whose bound reaches the k-th match found there. Blocks
meet their queries in numpy, and at most k rows per query and block leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline import config as cfg
from siftline.functions.durable import durable
from siftline.functions.text import pick
from siftline.operators import lookup

# Vectors of a block, and visiting queries, that meet in one task.
BLOCK_ROWS = 20_000
# Numbers of a matrix that a task holds at a time, and rows that it hands on at a time: its memory
# follows them, not the number of vectors, queries or blocks.
_CELLS = 1 << 20
_HANDED = 1 << 14
# Angles come from rounded cosines; bounds keep this much distance.
_ANGLE_MARGIN = 1e-6
# Blocks without a centroid: vectors of a length that no centroid has, and zero vectors.
_UNPLACED, _ZERO = -1, -2

INCIDENT_FIELDS = ("incident_id", "log", "known_root_cause", "known_action")
_MATCH = (
    "struct<incident_id:bigint,log:string,known_root_cause:string,known_action:string,"
    "similarity:double,is_similar_enough:boolean>"
)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; 0.0 when a norm is zero."""

    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    def dot(x: Column, y: Column) -> Column:
        return total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return _unit(np.array(vectors.tolist(), dtype=np.float64))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, unit vectors) of the rows of each vector length of a batch."""
    lists = batch.column("embedding")
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    for length in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == length)
        yield length, rows, _unit(flat[offsets[rows][:, None] + np.arange(length)])


def _slices(rows: int, width: int, most: int) -> Iterator[slice]:
    """Runs of rows that hold at most `most` cells of `width` columns, one row at least."""
    step = max(1, most // max(width, 1))
    return (slice(start, start + step) for start in range(0, rows, step))


class Centroids:
    """Unit vectors by length with the number of the first one of each length."""

    def __init__(self, vectors: list[list[float]]):
        by_length: dict[int, list[list[float]]] = {}
        for v in vectors:
            by_length.setdefault(len(v), []).append(v)
        self.first, self.of, n = {}, {}, 0
        for length, rows in sorted(by_length.items()):
            self.first[length], self.of[length] = n, _unit(np.array(rows, np.float64))
            n += len(rows)

    def angles(self, length: int, units: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(units @ self.of[length].T, -1.0, 1.0))

    def place(self, length: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block and angle to its centroid of each vector."""
        block, angle = np.full(len(units), _UNPLACED), np.full(len(units), np.pi)
        if length in self.first:
            for part in _slices(len(units), len(self.of[length]), _CELLS):
                angles = self.angles(length, units[part])
                nearest = angles.argmin(axis=1)
                block[part], angle[part] = nearest + self.first[length], angles[np.arange(len(nearest)), nearest]
        zero = ~units.any(axis=1)
        block[zero], angle[zero] = _ZERO, 0.0
        return block, angle


def _centroids(memory: DataFrame, count: int) -> Centroids:
    """`count` memory vectors in the order of their hashed ids; any choice gives the same result."""
    some = memory.orderBy(F.xxhash64("incident_id"), "incident_id").limit(count).select("embedding")
    return Centroids([v for v in (list(r["embedding"]) for r in some.collect()) if any(v)])


def _placed(memory: DataFrame, centroids) -> DataFrame:
    """incident_id, embedding, length, block, angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, blocks, angles = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for length, rows, units in _by_length(batch):
                lengths[rows] = length
                blocks[rows], angles[rows] = centroids.value.place(length, units)
            columns = [*batch.columns, pa.array(lengths), pa.array(blocks), pa.array(angles)]
            yield pa.RecordBatch.from_arrays(columns, names=["incident_id", "embedding", "length", "block", "angle"])

    slim = memory.select("incident_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "incident_id long, embedding array<double>, length int, block int, angle double")


class Blocks:
    """Size and radius of every block of every vector length: two numbers a block."""

    def __init__(self, stats: list[tuple[int, int, int, float]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in {row[0] for row in stats}:
            rows = sorted(row[1:] for row in stats if row[0] == length)
            self.of[length] = tuple(np.array(c) for c in zip(*rows))

    def bounds(self, centroids: Centroids, length: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks, their sizes, and for every query the largest cosine that each may hold."""
        block, size, radius = self.of[length]
        best = np.ones((len(units), len(block)))
        best[:, block == _ZERO] = 0.0
        near = block >= 0
        if near.any():
            apart = centroids.angles(length, units)[:, block[near] - centroids.first[length]] - radius[near]
            best[:, near] = np.cos(np.clip(apart - _ANGLE_MARGIN, 0.0, np.pi))
        # A zero vector has cosine 0 with all others and no angle to any.
        best[~units.any(axis=1)] = 0.0
        return block, size, best


_VISIT = "query_id long, embedding array<double>, length int, block int, kth double"


def _visits(queries: DataFrame, centroids, blocks, k: int, first_pass: bool) -> DataFrame:
    """One row per query and block to open.

    First pass: the blocks of the best bounds, until they hold more than k vectors. Second
    pass (`kth`: the k-th similarity found, null if there were fewer): all others that may hold
    a match as good as that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            for length, rows, units in _by_length(batch) if batch.num_rows else ():
                if length not in blocks.value.of:
                    continue
                for part in _slices(len(rows), len(blocks.value.of[length][0]), _HANDED):
                    own = rows[part]
                    block, size, best = blocks.value.bounds(centroids.value, length, units[part])
                    order = np.argsort(-best, axis=1, kind="stable")
                    held = np.cumsum(size[order], axis=1) - size[order]
                    opened = np.zeros_like(best, bool)
                    np.put_along_axis(opened, order, held <= k, axis=1)
                    if not first_pass:
                        floor = np.where(np.isnan(kth[own]), -2.0, kth[own])
                        opened = ~opened & (np.round(best + 1e-9, 4) >= floor[:, None])
                    query, which = np.nonzero(opened)
                    taken = batch.take(pa.array(own[query]))
                    columns = [taken.column("query_id"), taken.column("embedding"), pa.array(np.full(len(query), length, np.int32)), pa.array(block[which].astype(np.int32)), taken.column("kth")]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "embedding", "length", "block", "kth"])

    return queries.select("query_id", "embedding", "kth").mapInArrow(run, _VISIT)


_CANDIDATE = "query_id bigint, incident_id bigint, exact double"


def _best_in_block(queries: pd.DataFrame, memory: pd.DataFrame, k: int, exclude_same_id: bool) -> pd.DataFrame:
    """The k best memory vectors of each query by rounded similarity, equal ones by id."""
    memory = memory.sort_values("incident_id", ignore_index=True)
    known, ids = _matrix(memory["embedding"]), memory["incident_id"].to_numpy()
    found = []
    for rows in _slices(len(queries), len(known), _CELLS):
        part = queries.iloc[rows]
        asked = part["query_id"].to_numpy()
        exact = _matrix(part["embedding"]) @ known.T
        shown = np.round(exact, 4)
        if exclude_same_id:
            shown[asked[:, None] == ids[None, :]] = -np.inf
        rows = np.arange(len(part))
        for _ in range(min(k, shown.shape[1])):
            # Sorted by id, so the first maximum is the one with the lowest id.
            best = shown.argmax(axis=1)
            live = np.isfinite(shown[rows, best])
            found.append(pd.DataFrame({"query_id": asked[live], "incident_id": ids[best[live]], "exact": exact[rows[live], best[live]]}))
            shown[rows, best] = -np.inf
    return pd.concat(found, ignore_index=True)


def _open_blocks(visits: DataFrame, placed: DataFrame, sizes: DataFrame, k: int, exclude_same_id: bool, block_rows: int) -> DataFrame:
    """Matches of visiting queries in their blocks.

    A large block is dealt to parts by hashed id, which all its queries visit; the queries of a
    much visited block are dealt to parts that each get the block's vectors. So neither side of a
    task's group outgrows `block_rows`, as far as hashes are even.
    """
    parts = lambda n: F.greatest(F.ceil(n / F.lit(float(block_rows))), F.lit(1)).cast("int")
    key = ["length", "block"]
    seen = visits.groupBy(*key).agg(F.count("*").alias("_asking")).join(F.broadcast(sizes), key)
    # One row per block, and there is a block for every `block_rows` vectors.
    cut = F.broadcast(seen.select(*key, parts(F.col("n")).alias("_rows"), parts(F.col("_asking")).alias("_queries")))

    def dealt(frame: DataFrame, own_id: str, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        with_parts = frame.join(cut, key).withColumn(own, F.pmod(F.xxhash64(own_id), F.col(own_parts)).cast("int"))
        return with_parts.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1))).drop("_rows", "_queries")

    left = dealt(visits, "query_id", "_q", "_queries", "_m", "_rows")
    right = dealt(placed, "incident_id", "_m", "_rows", "_q", "_queries")
    group = [*key, "_q", "_m"]

    def match(queries: pd.DataFrame, memory: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(memory):
            return pd.DataFrame({"query_id": [], "incident_id": [], "exact": []})
        return _best_in_block(queries, memory, k, exclude_same_id)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(match, _CANDIDATE)


def _top(found: DataFrame, k: int) -> DataFrame:
    shown = found.withColumn("similarity", F.round("exact", 4))
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "incident_id")
    return shown.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)


def nearest_incidents(queries: DataFrame, memory: DataFrame, k: int, exclude_same_id: bool, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, incident_id, exact, similarity (rounded), _place (from 1): the k best of every query.

    queries: query_id, embedding; memory: incident_id (unique), embedding; all vectors usable.
    One centroid per `block_rows` vectors and two numbers per block reach the driver.
    """
    context = queries.sparkSession.sparkContext
    total = memory.count()
    chosen = _centroids(memory, -(-total // block_rows))
    centroids = context.broadcast(chosen)
    placed = durable(_placed(memory, centroids))
    sizes = placed.groupBy("length", "block").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    stats = [tuple(r) for r in sizes.collect()]
    blocks = context.broadcast(Blocks(stats))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("double").alias("kth"))
    first = _visits(asked, centroids, blocks, k, True)
    found = _open_blocks(first, placed, sizes, k, exclude_same_id, block_rows)
    if len(stats) == 1:
        return _top(found, k)
    found = durable(found)
    kth = _top(found, k).filter(F.col("_place") == k).select("query_id", F.col("similarity").alias("kth"))
    bounded = asked.drop("kth").join(kth, "query_id", "left")
    second = _visits(bounded, centroids, blocks, k, False)
    return _top(found.unionByName(_open_blocks(second, placed, sizes, k, exclude_same_id, block_rows)), k)


def top_incidents(
    queries: DataFrame,
    memory: DataFrame,
    k: int = 3,
    threshold: float = cfg.DecisionPolicy.similarity_threshold,
    exclude_same_id: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`query_id` and `similar_incidents`, the k most similar rows of `memory`.

    queries: query_id, embedding, both unique by id. memory: incident_id, log, known_root_cause,
    known_action, embedding. Similarity is rounded to four digits and decides the order,
    equal values by id; `is_similar_enough` is taken on the unrounded value. Only ids and
    vectors take part in the search; the fields of matched incidents are attached after it.
    Null vectors, empty ones, vectors with null or NaN entries and vectors of another length match
    nothing; a query without a match keeps its row with an empty list.
    """
    usable = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size("embedding") > 0), F.lit(False))
    asked = queries.select(F.col("query_id").cast("bigint"))
    wanted = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "embedding").filter(usable)
    known = memory.select(F.col("incident_id").cast("bigint").alias("incident_id"), "embedding").filter(usable)
    found = durable(nearest_incidents(wanted, known, k, exclude_same_id, block_rows))
    # One incident may be the match of most queries.
    matched = found.groupBy("incident_id").agg(F.count("*").alias("_matches"))
    fields = memory.filter(usable).select(*INCIDENT_FIELDS).join(matched, "incident_id")
    full = lookup.attach(found, fields, "incident_id", "_matches", spread="query_id")
    match = F.struct(*INCIDENT_FIELDS, "similarity", (F.col("exact") >= threshold).alias("is_similar_enough"))
    placed = full.select("query_id", F.struct("_place", match.alias("match")).alias("_m"))
    listed = F.transform(F.array_sort(F.collect_list("_m")), lambda m: m["match"]).cast(f"array<{_MATCH}>")
    every = placed.unionByName(asked, allowMissingColumns=True)
    return every.groupBy("query_id").agg(listed.alias("similar_incidents"))


def _agreement(similar: Column) -> Column:
    """Votes of the most frequent action among the first three incidents."""
    actions = [F.get(similar, F.lit(i))["known_action"] for i in range(3)]
    counts = [
        reduce(lambda x, y: x + y, [F.coalesce((a == b).cast("int"), F.lit(0)) for b in actions])
        for a in actions
    ]
    return F.greatest(*counts)


def vote(matches: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Add top similarity, agreement and whether the match is strong and consistent."""
    similar = F.col("similar_incidents")
    top = F.get(similar, F.lit(0))["similarity"]
    agreement = _agreement(similar)
    strong = F.coalesce(top >= policy.similarity_threshold, F.lit(False))
    return matches.withColumns(
        {
            "top_similarity": top,
            "agreement": agreement,
            "is_strong": strong,
            "is_consistent": agreement >= 2,
            "strong_and_consistent": strong & (agreement >= 2),
        }
    )


def similarity_columns(policy: cfg.DecisionPolicy) -> dict[str, Column]:
    """Decision columns taken from the best incident (its action, not the majority's)."""
    best = F.get(F.col("similar_incidents"), F.lit(0))
    return {
        "strategy_used": F.lit(cfg.STRATEGY_SIMILARITY),
        "predicted_action": best["known_action"],
        "confidence": F.round(best["similarity"], 4),
        "risk_level": pick("similar_incidents[0].known_action", policy.action_risk),
        "requires_approval": pick("similar_incidents[0].known_action", policy.needs_approval),
        "reason": F.lit(cfg.TEXT_SIMILAR),
        "router_reason": F.when(
            best["similarity"] >= policy.exact_similarity, F.lit(cfg.TEXT_SIMILAR_EXACT)
        ).otherwise(F.lit(cfg.TEXT_SIMILAR_AGREED)),
    }


def similarity_decision(matches: DataFrame, policy: cfg.DecisionPolicy) -> DataFrame:
    """Decisions for strong and consistent matches."""
    return (
        vote(matches, policy)
        .filter("strong_and_consistent")
        .withColumns(similarity_columns(policy))
    )
