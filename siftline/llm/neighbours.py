"""Nearest neighbours by inner product from a forest of sorted hash strings.

Every tree gives a vector a string of digits. A digit is the coordinate of largest size, with
its sign, of a random projection: vectors at a small angle share it more often. A tree is the
array of all strings in order, cut into segments of even size. A query descends each tree to
the rows with the longest common prefix; what it finds there bounds how near its k-th neighbour
is, and from the known chance that vectors so near share a digit follows how far all trees have to
ascend together, so that a neighbour is missed with a chance of at most `miss`. At the root, one tree
holds all rows and the answer is exact.

Vectors of different norms get one more coordinate, which makes their angle to a query fall with
the inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.llm.common import mix64, written

K = 20
TREES, DIGITS = 32, 7
# A digit has 2 * PROJECTED values; a string and the tie bits of its id fill 63 bits.
PROJECTED = 32
DIGIT_BITS = 6
TIE_BITS = 63 - DIGITS * DIGIT_BITS
# Chance to miss a neighbour that the trees may have.
MISS = 0.08
SEGMENT_ROWS, SEGMENT_QUERIES = 8_192, 8_192
# Rows on either side of its place that a query looks at on the way down.
WINDOW = 32
_SEED = 20_240


def projections(dim: int, trees: int = TREES) -> np.ndarray:
    """(dim + 1, trees * DIGITS * PROJECTED) Gaussian numbers, the same in every process."""
    return np.random.default_rng(_SEED).standard_normal((dim + 1, trees * DIGITS * PROJECTED), np.float32)


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) strings: DIGITS digits of DIGIT_BITS bits, the first one highest."""
    out = []
    for start in range(0, len(vectors), 1_024):
        seen = (vectors[start : start + 1_024].astype(np.float32) @ planes).reshape(-1, planes.shape[1] // PROJECTED, PROJECTED)
        best = np.abs(seen).argmax(axis=2)
        digit = 2 * best + (np.take_along_axis(seen, best[:, :, None], axis=2)[:, :, 0] > 0)
        digit = digit.reshape(len(seen), -1, DIGITS).astype(np.int64)
        out.append((digit << (DIGIT_BITS * np.arange(DIGITS - 1, -1, -1))).sum(axis=2))
    return np.concatenate(out) if out else np.zeros((0, planes.shape[1] // PROJECTED // DIGITS), np.int64)


def share_chances(dim: int, planes: np.ndarray, pairs: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Chance that two vectors of a cosine share a digit, on a grid of cosines, from `pairs` random pairs each."""
    grid = np.linspace(0.0, 1.0, 26)
    rnd = np.random.default_rng(_SEED + 1)
    a, b = (rnd.standard_normal((pairs, dim + 1)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    chances = []
    for cosine in grid:
        x, y = hash_strings(a, planes), hash_strings(cosine * a + np.sqrt(1 - cosine**2) * b, planes)
        differing = (x ^ y)[:, :, None] >> (DIGIT_BITS * np.arange(DIGITS)) & ((1 << DIGIT_BITS) - 1)
        chances.append((differing == 0).mean())
    return grid, np.maximum.accumulate(chances)


def needed_levels(cosines: np.ndarray, grid: np.ndarray, chances: np.ndarray, trees: int, miss: float = MISS) -> np.ndarray:
    """Longest common prefix at which a vector of that cosine is missed by all trees with chance `miss` at most."""
    chance = np.interp(np.nan_to_num(cosines, nan=-1.0), grid, chances)
    levels = np.arange(DIGITS + 1)
    missed = (1 - chance[:, None] ** levels) ** trees
    return np.where(missed <= miss, levels, 0).max(axis=1)


def usable(vector: Column) -> Column:
    """True for a vector with finite components that are not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector of the rows that take part, one per id. Floats stay floats, as copies travel."""
    kind = vectors.select(vector_col).schema[0].dataType.simpleString()
    vector = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    return slim.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _squares(vector: str) -> Column:
    return F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda acc, v: acc + v * v)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up component by component: equal vectors give equal scores."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _best(query: np.ndarray, row: np.ndarray, rough: np.ndarray, q: pd.DataFrame, m: pd.DataFrame, qv: np.ndarray, mv: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of the pairs (query, row) of each query, by exact score and then by vec_id."""
    ids = m["vec_id"].to_numpy()
    other = q["query_id"].to_numpy()[query] != ids[row]
    query, row, rough = query[other], row[other], rough[other]
    order = np.lexsort((-rough, query))
    query, row, rough = query[order], row[order], rough[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    count = np.diff(np.append(first, len(query)))
    # Pairs within rounding of the k-th rough product stay for the exact comparison.
    kth = np.repeat(rough[first + np.minimum(count, k) - 1], count)
    near = rough >= kth - 1e-9 * np.maximum(1.0, np.abs(kth))
    query, row = query[near], row[near]
    score = _ordered_dot(qv[query], mv[row])
    order = np.lexsort((ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = place < k
    return pd.DataFrame({"query_id": q["query_id"].to_numpy()[query[keep]], "vec_id": ids[row[keep]], "score": score[keep]})


def _vectors(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["vector"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 1))


_FOUND = "query_id long, vec_id long, score double"


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


def _descend(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of the `WINDOW` rows before and after each query's place in the sorted segment.

    Rows around that place are the ones with the longest common prefixes.
    """
    if not len(rows) or not len(queries):
        return _empty()
    rows = rows.sort_values(["string", "vec_id"], ignore_index=True)
    qv, mv = _vectors(queries), _vectors(rows)
    place = np.searchsorted(rows["string"].to_numpy(), queries["string"].to_numpy())
    near = place[:, None] + np.arange(-WINDOW, WINDOW)
    inside = (near >= 0) & (near < len(rows))
    query, row = np.nonzero(inside)[0], near[inside]
    return _best(query, row, np.einsum("ij,ij->i", qv[query], mv[row]), queries, rows, qv, mv, k)


def _ascend(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best of all rows of the sorted segment whose strings share each query's prefix.

    Rows below the k-th score of the way down cannot be among the k nearest and are left out.
    """
    if not len(rows) or not len(queries):
        return _empty()
    rows = rows.sort_values(["string", "vec_id"], ignore_index=True)
    queries = queries.sort_values(["first", "last", "query_id"], ignore_index=True)
    qv, mv = _vectors(queries), _vectors(rows)
    strings, least = rows["string"].to_numpy(), queries["kth"].fillna(-np.inf).to_numpy()
    low = np.searchsorted(strings, queries["first"].to_numpy())
    high = np.searchsorted(strings, queries["last"].to_numpy(), side="right")
    # Queries with the same prefix look at the same rows: one matrix product for each run of them.
    runs = np.flatnonzero(np.diff(low * (len(rows) + 1) + high, prepend=-1))
    found = []
    for start, stop in zip(runs, np.append(runs[1:], len(queries))):
        a, b = low[start], high[start]
        if a == b:
            continue
        for at in range(start, stop, 256):
            asked = np.arange(at, min(at + 256, stop))
            products = qv[asked] @ mv[a:b].T
            if b - a > 2 * k + 8:
                # One place more for the query itself; equal ones at the edge stay.
                edge = -np.partition(-products, k + 1, axis=1)[:, k + 1 : k + 2]
                wanted = products >= edge - 1e-9 * np.maximum(1.0, np.abs(edge))
            else:
                wanted = np.ones_like(products, bool)
            wanted &= products >= (least[asked] - 1e-9 * np.maximum(1.0, np.abs(np.maximum(least[asked], -1e300))))[:, None]
            query, row = np.nonzero(wanted)
            if len(query):
                found.append(_best(asked[query], a + row, products[query, row], queries, rows, qv, mv, k))
    return pd.concat(found, ignore_index=True) if found else _empty()


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Forest:
    """The index of one table: strings of every row in every tree, and the segments' bounds.

    `vectors` is a table of vec_id and vector with one length and one row per id. `bounds` has
    for each tree the first string of every segment but the first: 8 bytes for each
    `SEGMENT_ROWS` rows and tree, the only part of the index that the driver holds.
    """

    def __init__(self, vectors: DataFrame, dim: int, rows: int, norm: float, k: int = K, trees: int = TREES, segment_rows: int = SEGMENT_ROWS, miss: float = MISS):
        self.dim, self.norm, self.k, self.trees, self.miss = dim, norm, k, trees, miss
        self.spark = vectors.sparkSession
        self.planes = self.spark.sparkContext.broadcast(projections(dim, trees))
        self.grid, self.chances = share_chances(dim, self.planes.value)
        # Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query.
        copy = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
        single = vectors.withColumn("_copy", copy).filter(F.col("_copy") <= k + 1).drop("_copy")
        self.rows = written(self._hashed(single, "vec_id", False), "neighbours-rows")
        self.segments = max(1, -(-rows // segment_rows))
        shares = [i / self.segments for i in range(1, self.segments)]
        bounds = [np.zeros(0, np.int64)] * trees
        if shares:
            sketch = [F.percentile_approx(F.col("strings")[t], shares, 10 * self.segments).alias(f"t{t}") for t in range(trees)]
            bounds = [np.unique(np.array(b, np.int64)) for b in self.rows.agg(*sketch).first()]
        self.bounds = self.spark.sparkContext.broadcast(bounds)

    def _hashed(self, vectors: DataFrame, id_col: str, asking: bool) -> DataFrame:
        """id, vector, strings. A row gets the coordinate that stands for its norm; a query has 0 there."""
        planes, norm = self.planes, self.norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("vector"))
                size = np.linalg.norm(x, axis=1, keepdims=True)
                unit = x / size if asking else x / norm
                rest = np.zeros((len(x), 1)) if asking else np.sqrt(np.maximum(0.0, 1.0 - (size / norm) ** 2))
                strings = hash_strings(np.hstack([unit, rest]), planes.value) << TIE_BITS
                ids = batch.column(id_col).to_numpy()
                # Tie bits let a segment end between equal strings.
                if not asking:
                    strings |= (mix64(ids.view(np.uint64)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * strings.shape[1], pa.int32()), pa.array(strings.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("vector"), lists], names=[id_col, "vector", "strings"])

        kind = vectors.schema["vector"].dataType.simpleString()
        return vectors.select(id_col, "vector").mapInArrow(run, f"{id_col} long, vector {kind}, strings array<long>")

    def _segment(self, tree: Column, string: Column) -> Column:
        """Number of the segment that holds a string: bounds up to it, by a broadcast array."""
        bounds = self.bounds

        @F.pandas_udf("int")
        def find(trees: pd.Series, strings: pd.Series) -> pd.Series:
            out = np.zeros(len(trees), np.int32)
            for t in np.unique(trees):
                own = (trees == t).to_numpy()
                out[own] = np.searchsorted(bounds.value[t], strings.to_numpy()[own], side="right")
            return pd.Series(out)

        return find(tree, string)

    def _placed_rows(self) -> DataFrame:
        """tree, segment, vec_id, string, vector: every row once per tree."""
        each = self.rows.select("vec_id", "vector", F.posexplode("strings").alias("tree", "string"))
        return each.withColumn("segment", self._segment(F.col("tree"), F.col("string")))

    def _meet(self, visits: DataFrame, look) -> DataFrame:
        """Rows of each segment and the queries that visit it, the queries of a much visited one in parts.

        Visits are counted first, so neither side of a group outgrows `SEGMENT_QUERIES` or a segment.
        """
        k = self.k
        counts = visits.groupBy("tree", "segment").count().filter(F.col("count") > SEGMENT_QUERIES)
        # At most visits / SEGMENT_QUERIES rows.
        parts = counts.select("tree", "segment", F.ceil(F.col("count") / SEGMENT_QUERIES).cast("int").alias("parts"))
        split = F.coalesce("parts", F.lit(1))
        asked = visits.join(F.broadcast(parts), ["tree", "segment"], "left").withColumn("part", F.pmod(F.xxhash64("query_id"), split).cast("int")).drop("parts")
        rows = self._placed_rows().join(F.broadcast(parts), ["tree", "segment"], "left")
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), split - 1))).drop("parts")
        group = ["tree", "segment", "part"]

        def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return look(queries, rows, k)

        return asked.groupBy(*group).cogroup(rows.groupBy(*group)).applyInPandas(meet, _FOUND)

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest rows of each query (query_id, vector)."""
        asked = written(self._hashed(queries, "query_id", True), "neighbours-queries")
        each = asked.select("query_id", "vector", F.posexplode("strings").alias("tree", "string"))
        down = each.withColumn("segment", self._segment(F.col("tree"), F.col("string")))
        met = written(self._meet(down, _descend), "neighbours-descent")
        # The k-th score so far, as a cosine of the lengthened vectors, bounds the true one from below.
        kth = _top(met, self.k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        kth = kth.filter(F.col("n") == self.k).select("query_id", "kth")
        bounded = asked.join(kth, "query_id", "left")
        grid, chances, trees, miss, norm = self.grid, self.chances, self.trees, self.miss, self.norm

        @F.pandas_udf("int")
        def level(scores: pd.Series, sizes: pd.Series) -> pd.Series:
            return pd.Series(needed_levels(scores.to_numpy(float) / (sizes.to_numpy() * norm), grid, chances, trees, miss), dtype="int32")

        size = F.sqrt(_squares("vector"))
        levelled = bounded.withColumn("level", level("kth", size))
        # At level 0 the first tree alone holds every row.
        opened = levelled.select("query_id", "vector", "kth", "level", F.posexplode("strings").alias("tree", "string")).filter("level > 0 OR tree = 0")
        # The strings with the same first `level` digits, whatever follows.
        free = F.expr(f"IF(level = 0, {(1 << 63) - 1}L, shiftleft(1L, {TIE_BITS + DIGITS * DIGIT_BITS} - {DIGIT_BITS} * level) - 1)")
        spans = opened.withColumn("first", F.col("string").bitwiseAND(F.bitwise_not(free))).withColumn("last", F.col("first") + free)
        ends = spans.withColumns({"_from": self._segment(F.col("tree"), F.col("first")), "_to": self._segment(F.col("tree"), F.col("last"))})
        visits = ends.withColumn("segment", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to", "level")
        found = met.unionByName(self._meet(visits, _ascend))
        return _top(found, self.k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The k nearest rows of each row whose id `every` divides: query_id, rank, vec_id, score.

    Nearness is the largest inner product in doubles, ties to the smaller id; the row itself is
    no answer. Null vectors, zero vectors, and vectors with null or non-finite components take no part,
    nor do rows without an id and vectors of another length than the most frequent one (the longer
    of equally frequent ones). Of several vectors of one id the smallest one counts. An
    empty table gives no rows. Other columns are not read.
    """
    rows = written(prepared(vectors, id_col, vector_col), "neighbours-vectors")
    by_length = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(_squares("vector")).alias("most"))
    kind = by_length.orderBy(F.desc("n"), F.desc("dim")).first()
    if kind is None:
        return rows.select("vec_id").limit(0).selectExpr("vec_id AS query_id", "CAST(0 AS int) AS rank", "vec_id", "CAST(0 AS double) AS score")
    rows = rows.filter(F.size("vector") == kind["dim"])
    forest = Forest(rows, kind["dim"], kind["n"], float(np.sqrt(kind["most"])), k, trees, segment_rows)
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return forest.search(queries)
