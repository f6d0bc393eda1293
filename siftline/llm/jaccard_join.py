"""Similarity join of documents on word shingles by a token-group matrix.

Documents link when the Jaccard likeness of their sets of five-word shingles is 0.75 or more.
Equal sets are one node. Nodes that share a least hashed shingle form buckets; those verified
against their bucket's leader become a group with it, in three rounds with three hashes. The
matrix holds for every shingle the groups it occurs in, only for the columns that the threshold
needs: a set's rarest quarter, in one global order. Two groups that meet in a column and whose
sizes and positions allow the threshold are opened, together with the groups that meet them too:
a query is first bounded by its overlap with the union of the members' shingles, then compared.
The first bound reads bitmaps of the sets and of the unions only, so that few whole sets travel:
a bit that a query has and a union lacks stands for a shingle outside it. Links between groups are closed into components. The order only decides how much work there is; every link
between different groups is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import coded, gather_ragged, join_uneven, mix64, slices, split_words, written

WORDS = 5
ROUNDS = 3
CELL_BITS = 20  # cells of the frequency sketch behind the order of the shingles
BUCKET_TOKENS = 1_500_000  # matrix entries that one task joins
CHUNK = 256  # members of a group that are opened at once
QUERIES = 10_000  # queries that one task compares with a chunk
BROADCAST_BYTES = 64 << 20
_STEP, _SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_SEEDS = [np.uint64(s) for s in (0x2545F4914F6CDD1D, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    words, bounds = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    codes, distinct = coded(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    one = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    reach = max(0, len(one) - WORDS + 1)
    shingles = np.zeros(reach, np.uint64)
    for k in range(WORDS):
        shingles = mix64(shingles * _STEP + one[k : k + reach])
    sets = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= WORDS:
            sets.append(np.unique(shingles[begin : end - WORDS + 1]))
        elif end > begin:
            short = np.full(1, _SHORT + np.uint64(end - begin))
            for k in range(begin, end):
                short = mix64(short * _STEP + one[k : k + 1])
            sets.append(short)
        else:
            sets.append(one[:0])
    return sets


def needed(n: np.ndarray | int):
    """Least overlap of a set of n with any set that it links to."""
    return (3 * n + 3) // 4


def bitmap(tokens: np.ndarray) -> bytes:
    """One bit for the residue of each token, over a power of two of bits, twice the tokens at least."""
    width = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[tokens & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The bitmap of the same tokens over `length` bytes, a power of two not above its own."""
    return bits if len(bits) == length else np.bitwise_or.reduce(bits.reshape(-1, length), axis=0)


def union_bitmap(blobs: list[bytes]) -> np.ndarray:
    """The bitmap of the union, at the width of the narrowest of `blobs`."""
    length = min(map(len, blobs))
    union = np.zeros(length, np.uint8)
    for blob in blobs:
        union |= _folded(np.frombuffer(blob, np.uint8), length)
    return union


def may_link(n: int, bits: bytes, least: int, most: int, members: int, union: bytes) -> bool:
    """Whether a set of n may link to one of `members` sets of least to most tokens with that union."""
    if 4 * most < 3 * n or 4 * n < 3 * least:
        return False
    own, other = np.frombuffer(bits, np.uint8), np.frombuffer(union, np.uint8)
    length = min(len(own), len(other))
    own, other = _folded(own, length), _folded(other, length)
    overlap = n - int(np.bitwise_count(own & ~other).sum())
    if members == 1:
        overlap = min(overlap, least - int(np.bitwise_count(other & ~own).sum()))
    return overlap >= needed(n) and 7 * overlap >= 3 * (n + least)


_PROFILE = "doc_id long, n_shingles long, sig_a long, sig_b long, key0 long, key1 long, key2 long, bits binary, cell int, df long"


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document with its set's size, digest and least hashes; and the tasks' frequency cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PROFILE.split(", ")]
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            sizes = np.array([len(s) for s in sets], np.int64)
            filled = sizes > 0
            columns = [np.zeros(len(sets), np.int64) for _ in range(5)]
            if filled.any():
                flat = np.concatenate(sets)
                starts = (np.cumsum(sizes) - sizes)[filled]
                cells += np.bincount((flat >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
                for k, seed in enumerate(_SEEDS):
                    reduce = np.add if k < 2 else np.minimum
                    columns[k][filled] = reduce.reduceat(mix64(flat ^ seed), starts).view(np.int64)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), *map(pa.array, columns), pa.array(map(bitmap, sets), pa.binary()), none.cast(pa.int32()), none],
                names=names,
            )
        used = np.flatnonzero(cells)
        for some in (used[k : k + (1 << 16)] for k in range(0, len(used), 1 << 16)):
            empty = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [empty] * 7 + [pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(cells[some])], names=names
            )

    return docs.mapInArrow(run, _PROFILE)


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, tokens) for the documents whose ids are in `nodes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tokens], names=["node", "tokens"])

    few = F.broadcast(nodes) if nodes.count() * 16 <= BROADCAST_BYTES else nodes
    return docs.join(few, docs["doc_id"] == nodes["node"], "left_semi").mapInArrow(run, "node long, tokens binary")


def _bits_of(profile: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, bits) for the ids in `nodes`."""
    few = F.broadcast(nodes) if nodes.count() * 16 <= BROADCAST_BYTES else nodes
    rows = profile.filter(F.col("bits").isNotNull()).select("doc_id", "bits")
    return rows.join(few, rows["doc_id"] == nodes["node"], "left_semi").groupBy(F.col("doc_id").alias("node")).agg(F.min("bits").alias("bits"))


def _promising(pairs: DataFrame, keep: str) -> DataFrame:
    """The columns `keep` of the rows whose n_shingles and bits pass `may_link` against the rest."""
    names = keep.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bits"):
            columns = [batch.column(c).to_pylist() for c in ("n_shingles", "bits", "least", "most", "members", "union")]
            passed = pa.array([may_link(*row) for row in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(names).filter(passed)

    return pairs.select(*names, "n_shingles", "bits", "least", "most", "members", "union").mapInArrow(run, keep)


def _linked(roles: DataFrame) -> DataFrame:
    """(node, grp): the queries and the groups of the members that they link to.

    `roles` has block, part, query, node, grp and tokens. All rows of a part meet in one task,
    members first; queries pass by one at a time. The members' matrix (for each shingle of their
    union the members that have it) gives a query's overlap with the union, and, if that allows
    a link, with every member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, groups, matrix = None, [], [], None
        for batch in slices(batches, "tokens", 4 << 20):
            out: set[tuple[int, int]] = set()
            columns = [batch.column(c).to_pylist() for c in ("block", "part", "query", "node", "grp", "tokens")]
            for block, part, query, node, grp, blob in zip(*columns, strict=True):
                if (block, part) != current:
                    current, members, groups, matrix = (block, part), [], [], None
                own = np.frombuffer(blob, np.uint64)
                if not query:
                    members.append(own)
                    groups.append(grp)
                    continue
                if not members:
                    continue
                if matrix is None:
                    matrix = _member_matrix(members)
                    sizes, group_of = np.array([len(m) for m in members]), np.array(groups)
                union, starts, counts, holders = matrix
                at = np.minimum(np.searchsorted(union, own), len(union) - 1)
                at = at[union[at] == own]
                if len(at) < needed(len(own)):
                    continue
                common = np.bincount(gather_ragged(holders, starts[at], counts[at]), minlength=len(sizes))
                linked = 100 * common >= 75 * (sizes + len(own) - common)
                out.update((node, g) for g in set(group_of[linked].tolist()))
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["node", "grp"])

    dealt = roles.repartition("block", "part").sortWithinPartitions("block", "part", "query")
    return dealt.select("block", "part", "query", "node", "grp", "tokens").mapInArrow(run, "node long, grp long").distinct()


def _member_matrix(members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The union of the members' shingles, and for each one where its holders stand and how many."""
    tokens = np.concatenate(members)
    holders = np.repeat(np.arange(len(members)), [len(m) for m in members])
    order = np.argsort(tokens, kind="stable")
    union, starts, counts = np.unique(tokens[order], return_index=True, return_counts=True)
    return union, starts, counts, holders[order]


def _gathered(docs: DataFrame, profile: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """One round: (root, grp) for the roots verified against the leader of their bucket by `key`."""
    roots = nodes.filter(F.col("node") == F.col("root")).select("node", "n_shingles", key)
    buckets = roots.groupBy(key).agg(F.count("*").alias("rows"), F.min(F.struct("node", "n_shingles")).alias("leader")).filter("rows > 1")
    pairs = join_uneven(roots, buckets, [key]).filter(F.col("leader.node") != F.col("node"))
    n, m = F.col("n_shingles"), F.col("leader.n_shingles")
    pairs = pairs.filter(F.least(n, m) * 4 >= F.greatest(n, m) * 3)
    parts = F.ceil(F.col("rows") / QUERIES).cast("int")
    pairs = written(pairs.select(F.col("leader.node").alias("grp"), "node", "n_shingles", m.alias("least"), parts.alias("parts")), "jaccard-pairs")
    bits = written(_bits_of(profile, pairs.select("node").union(pairs.select("grp")).distinct()), "jaccard-bits")
    both = join_uneven(pairs, bits.select(F.col("node").alias("grp"), F.col("bits").alias("union")), ["grp"]).join(bits, "node")
    both = both.withColumns({"most": F.col("least"), "members": F.lit(1)})
    queries = written(_promising(both, "grp long, node long, parts int"), "jaccard-pairs")
    members = queries.select("grp", "parts").distinct()
    sets = written(_sets_of(docs, queries.select("node").union(members.select("grp")).distinct()), "jaccard-sets")
    roles = queries.select("grp", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("query"), "node").unionByName(
        members.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("query"), F.col("grp").alias("node"))
    )
    roles = roles.withColumn("block", F.col("grp"))
    return _linked(roles.join(sets, "node")).select(F.col("node").alias("root"), "grp")


_ENTRIES = "bucket int, tokens binary, places binary, rests binary, groups binary"


def _matrix(docs: DataFrame, nodes: DataFrame, order: np.ndarray, buckets: int) -> DataFrame:
    """The token-group matrix as packed blocks: for each bucket of shingles a slice's entries.

    An entry says that members of a group with lo to hi shingles have the token in the columns
    that the threshold needs, with at most `rest` shingles from there on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = shared.value
        for batch in slices(batches, "text"):
            for some in (batch.slice(k, 1 << 15) for k in range(0, batch.num_rows, 1 << 15)):
                sets = shingle_sets(some.column("text"))
                roots = some.column("root").to_numpy(zero_copy_only=False)
                group, place = np.unique(roots, return_inverse=True)
                tokens, places, rests = [], [], []
                for s, p in zip(sets, place.tolist(), strict=True):
                    if not len(s):
                        continue
                    weight = frequency[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
                    head = np.argsort((weight << np.uint64(44)) | (s >> np.uint64(20)), kind="stable")[: len(s) - needed(len(s)) + 1]
                    tokens.append(s[head])
                    places.append(np.full(len(head), p, np.uint16))
                    rests.append(len(s) - np.arange(len(head)))
                if not tokens:
                    continue
                tokens, places, rests = np.concatenate(tokens), np.concatenate(places), np.concatenate(rests)
                sizes = np.array([len(s) for s in sets])
                lo, hi = np.full(len(group), np.iinfo(np.int64).max), np.zeros(len(group), np.int64)
                np.minimum.at(lo, place, np.where(sizes > 0, sizes, np.iinfo(np.int64).max))
                np.maximum.at(hi, place, sizes)
                head = np.lexsort((-rests, places, tokens))
                tokens, places, rests = tokens[head], places[head], rests[head]
                first = np.ones(len(head), bool)  # of a group's entries for a token the one with most behind it
                first[1:] = (tokens[1:] != tokens[:-1]) | (places[1:] != places[:-1])
                tokens, places, rests = tokens[first], places[first], rests[first].astype(np.uint32)
                bucket = (mix64(tokens) % np.uint64(buckets)).astype(np.int64)
                head = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[head], prepend=-1)).tolist()
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(head)], strict=True):
                    own = head[a:b]
                    used, short = np.unique(places[own], return_inverse=True)
                    table = np.stack([group[used], lo[used], hi[used]])
                    rows.append((int(bucket[own[0]]), tokens[own].tobytes(), short.astype(np.uint16).tobytes(), rests[own].tobytes(), table.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5)]],
                    names=["bucket", "tokens", "places", "rests", "groups"],
                )

    few = nodes.select("node", "root")
    few = F.broadcast(few) if few.count() * 32 <= BROADCAST_BYTES else few
    return docs.join(few, docs["doc_id"] == few["node"]).select("root", "text").mapInArrow(run, _ENTRIES)


def _meeting(rows: pd.DataFrame) -> pd.DataFrame:
    """(g1, g2) of one bucket: groups with a column in common whose sizes and rests allow a link."""
    tokens = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["tokens"]])
    rest = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["rests"]]).astype(np.int64)
    tables = [np.frombuffer(b, np.int64).reshape(3, -1)[:, np.frombuffer(p, np.uint16)] for b, p in zip(rows["groups"], rows["places"], strict=True)]
    group, lo, hi = np.concatenate(tables, axis=1)
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    shared = np.zeros(len(tokens), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order, tokens = order[shared], tokens[shared]
    group, lo, hi, rest = group[order], lo[order], hi[order], rest[order]
    order = np.lexsort((group, tokens))
    tokens, group, lo, hi, rest = tokens[order], group[order], lo[order], hi[order], rest[order]
    if not len(tokens):
        return pd.DataFrame({"g1": np.zeros(0, np.int64), "g2": np.zeros(0, np.int64)})
    first = np.flatnonzero(np.append(True, (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])))
    tokens, group = tokens[first], group[first]
    lo, hi, rest = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.maximum.reduceat(rest, first)
    ends = np.append(np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, len(tokens))
    end = np.repeat(ends, np.diff(np.append(0, ends)))
    found, held, reach = [], 0, np.arange(len(tokens))
    step = 1
    while len(reach := reach[reach + step < end[reach]]):
        i, j = reach, reach + step
        least_i, least_j = np.maximum(lo[i], needed(lo[j])), np.maximum(lo[j], needed(lo[i]))
        fits = (4 * hi[i] >= 3 * lo[j]) & (4 * hi[j] >= 3 * lo[i]) & (7 * np.minimum(rest[i], rest[j]) >= 3 * (least_i + least_j))
        if fits.any():
            found.append(np.stack([group[i[fits]], group[j[fits]]], axis=1))
            held += len(found[-1])
            if held > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = len(found[0]) // 2
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"g1": pairs[:, 0], "g2": pairs[:, 1]})


def _unions(rows: pd.DataFrame) -> pd.DataFrame:
    """The members of one group in one chunk as one row: their sizes' range, their count and their union's bitmap."""
    sizes = rows["n_shingles"]
    union = union_bitmap(rows["bits"].tolist()).tobytes()
    return pd.DataFrame({"grp": rows["root"].iloc[:1], "block": rows["block"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "least": sizes.min(), "most": sizes.max(), "members": len(rows), "union": [union]})


def _opened(docs: DataFrame, profile: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g1, g2): the group pairs between which a member of one links to a member of the other.

    Groups that meet often are laid in the same block: a block is named by the smallest group
    within two steps of meeting, and cut into chunks of members. A query that passes the bound
    against the union of a group's members in a chunk travels there, once for all such groups.
    """
    both = pairs.select("g1", "g2").union(pairs.select("g2", "g1"))
    near = both.groupBy(F.col("g1").alias("root")).agg(F.min("g2").alias("block"))
    near = written(near.select("root", F.least("root", "block").alias("block")), "jaccard-near")
    next_one = both.join(near.select(F.col("root").alias("g2"), "block"), "g2").groupBy(F.col("g1").alias("root")).agg(F.min("block").alias("further"))
    blocks = near.join(next_one, "root").select("root", F.least("block", "further").alias("block"))
    held = written(nodes.select("node", "root", "n_shingles").join(blocks, "root"), "jaccard-held")
    sizes = held.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = join_uneven(held, sizes, ["block"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    members = written(members.select("node", "root", "block", "chunk", "n_shingles"), "jaccard-members")
    bits = written(_bits_of(profile, held.select("node")), "jaccard-bits")
    unions = members.join(bits, "node").groupBy("root", "chunk").applyInPandas(
        _unions, "grp long, block long, chunk int, least long, most long, members long, union binary"
    )
    unions = written(unions, "jaccard-unions")
    # The smaller group asks, the larger one is opened.
    count = held.groupBy("root").agg(F.count("*").alias("members"))
    left, right = (count.select(F.col("root").alias(g), F.col("members").alias(m)) for g, m in (("g1", "m1"), ("g2", "m2")))
    turned = F.col("m1") > F.col("m2")
    asked = pairs.join(left, "g1").join(right, "g2").select(
        F.when(turned, F.col("g2")).otherwise(F.col("g1")).alias("root"), F.when(turned, F.col("g1")).otherwise(F.col("g2")).alias("grp")
    )
    asking = written(asked.join(held.select("node", "root", "n_shingles"), "root"), "jaccard-asked")
    asking = asking.join(bits, "node").join(unions, "grp")
    passed = written(_promising(asking, "node long, root long, grp long, block long, chunk int"), "jaccard-passed")
    queries = written(passed.select("node", "root", "block", "chunk").distinct(), "jaccard-queries")
    members = members.join(passed.select(F.col("grp").alias("root"), "chunk").distinct(), ["root", "chunk"])
    salts = written(queries.groupBy("block", "chunk").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("salts")), "jaccard-salts")
    asking = queries.join(salts, ["block", "chunk"]).select(
        "block", "chunk", "salts", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(1).alias("query"), "node", F.col("root").alias("grp")
    )
    opened = members.join(salts, ["block", "chunk"]).select(
        "block", "chunk", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("query"), "node", F.col("root").alias("grp")
    )
    part = (F.col("chunk").cast("long") * F.col("salts") + F.col("salt")).alias("part")
    roles = written(opened.unionByName(asking).select("block", part, "query", "node", "grp"), "jaccard-roles")
    sets = written(_sets_of(docs, roles.select("node").distinct()), "jaccard-sets")
    links = _linked(roles.join(sets, "node")).withColumnRenamed("grp", "g2")
    return links.join(held.select("node", F.col("root").alias("g1")), "node").filter("g1 != g2").select("g1", "g2").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(root, label): every end of an edge with the smallest root that its edges reach."""
    edges = written(edges.select("g1", "g2").union(edges.select("g2", "g1")).distinct(), "jaccard-edges")
    labels = written(edges.groupBy(F.col("g1").alias("root")).agg(F.min("g2").alias("label")).select("root", F.least("root", "label").alias("label")), "jaccard-labels")
    while True:
        near = edges.join(labels.select(F.col("root").alias("g2"), "label"), "g2").groupBy(F.col("g1").alias("root")).agg(F.min("label").alias("near"))
        stepped = written(labels.join(near, "root").select("root", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "jaccard-labels")
        if not stepped.filter("moved").limit(1).count():
            return labels
        # Every label is itself an end of an edge: follow it one step.
        jump = stepped.select(F.col("root").alias("label"), F.col("label").alias("further"))
        labels = written(stepped.select("root", "label").join(jump, "label").select("root", F.least("label", "further").alias("label")), "jaccard-labels")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links reach).

    Null and empty texts have no shingles and link to nothing, not even to each other; a text of
    fewer than five words is one shingle. Repeated rows are equal sets; an id stands for one
    text. Rows without an id get the component of an equal text that has one, else null.
    Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = written(_profile(docs), "jaccard-profile")
    rows = profile.filter(F.col("cell").isNull()).drop("cell", "df")
    keys = ["key0", "key1", "key2"]
    nodes = (
        rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy("sig_a", "sig_b")
        .agg(F.min("doc_id").alias("node"), *[F.min(c).alias(c) for c in ("n_shingles", *keys)])
    )
    nodes = written(nodes.withColumn("root", F.col("node")), "jaccard-nodes")
    cells = profile.filter(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("df").alias("df")).toArrow()  # 2**CELL_BITS rows
    order = np.zeros(1 << CELL_BITS, np.uint32)
    order[cells["cell"].to_numpy()] = np.minimum(cells["df"].to_numpy(), (1 << 20) - 1).astype(np.uint32)

    for key in keys[:ROUNDS]:
        links = written(_gathered(docs, profile, nodes, key), "jaccard-links")
        if links.limit(1).count():
            nodes = join_uneven(nodes, links, ["root"]).withColumn("root", F.coalesce("grp", "root")).drop("grp")
            nodes = written(nodes, "jaccard-nodes")
    total = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (4 * BUCKET_TOKENS)))
    matrix = _matrix(docs, nodes, order, buckets)
    pairs = written(matrix.groupBy("bucket").applyInPandas(_meeting, "g1 long, g2 long").distinct(), "jaccard-meet")
    links = written(_opened(docs, profile, nodes, pairs), "jaccard-links")
    labels = components(links)
    nodes = written(join_uneven(nodes, labels, ["root"]).select("node", "sig_a", "sig_b", F.coalesce("label", "root").alias("label")), "jaccard-nodes")
    least = nodes.groupBy("label").agg(F.min("node").alias("component_id"))
    nodes = join_uneven(nodes, least, ["label"]).select("sig_a", "sig_b", "component_id")
    linked = written(nodes, "jaccard-components")
    some = join_uneven(rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "sig_a", "sig_b"), linked, ["sig_a", "sig_b"])
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionByName(none)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with the smallest id of their component; all columns as they are.

    Documents without words, and rows without an id, stay.
    """
    found = jaccard_components(docs, id_col, text_col)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone")).distinct()
    gone = written(gone, "jaccard-gone")
    few = F.broadcast(gone) if gone.count() * 16 <= BROADCAST_BYTES else gone
    return docs.join(few, docs[id_col].cast("long") == F.col("__gone"), "left_anti")
