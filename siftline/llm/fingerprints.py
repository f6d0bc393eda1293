"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut further after words that their hash selects, so that an edit changes
only the pieces it touches. The n-th equal paragraph of a document counts as another one. Each
digest is added to three cells (count, sum of digests, sum of checks). Subtracting the cells of
two documents leaves their differences, and cells with a single digest left are peeled until
nothing remains. Where that fails, both sketches are made anew four times as large.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import coded, mix64, slices, split_words

CELLS = 24
PLACES = 3
_GROWTH = 4
_CUT = 8  # one word in so many ends a piece
_STEP, _COPY, _CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F)
_CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("digest", "<u8")])
# Rows that one task of the id order takes at least; the ranges follow the table.
RANGE_ROWS = 40_000
_FIRST = -(1 << 63)


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs of all texts, and each text's bounds in them (n + 1 offsets)."""
    lines = pc.split_pattern(pa.array(texts, pa.string()), "\n")
    line_bounds = lines.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words, word_bounds = split_words(lines.flatten())
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    codes, distinct = coded(words)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))[codes]
    opens = np.zeros(len(hashes) + 1, bool)
    opens[word_bounds] = True
    opens[1:] |= hashes % np.uint64(_CUT) == 0
    starts = np.flatnonzero(opens[:-1])
    sizes = np.diff(np.append(starts, len(hashes)))
    place = (np.arange(len(hashes)) - np.repeat(starts, sizes)).astype(np.uint64)
    digests = np.add.reduceat(mix64(hashes + place * _STEP), starts)
    bounds = np.searchsorted(starts, word_bounds[line_bounds])
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((digests, doc))
    ordered = digests[order]
    first = np.ones(len(order), bool)
    first[1:] = (ordered[1:] != ordered[:-1]) | (doc[order][1:] != doc[order][:-1])
    runs = np.flatnonzero(first)
    copy = np.arange(len(order)) - np.repeat(runs, np.diff(np.append(runs, len(order))))
    digests[order] = mix64(ordered + copy.astype(np.uint64) * _COPY)
    return digests, bounds


def _places(digests: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each third of the table."""
    third = cells // PLACES
    seeds = [np.uint64((k + 1 + cells) * int(_STEP) % 2**64) for k in range(PLACES)]
    turns = [mix64(digests + seed) % np.uint64(third) + np.uint64(k * third) for k, seed in enumerate(seeds)]
    return np.stack(turns).astype(np.int64)


def _checks(digests: np.ndarray) -> np.ndarray:
    return mix64(digests ^ _CHECK) & np.uint64(0xFFFFFFFF)


class Sketches:
    """The tables of several documents in one row of cells, document by document."""

    def __init__(self, n_docs: int, cells: int):
        self.n_docs, self.cells = n_docs, cells
        self.count = np.zeros(n_docs * cells, np.int64)
        self.digest = np.zeros(n_docs * cells, np.uint64)
        self.check = np.zeros(n_docs * cells, np.uint64)

    def add(self, doc: np.ndarray, digests: np.ndarray, sign: int | np.ndarray = 1) -> Sketches:
        at = (_places(digests, self.cells) + doc * self.cells).ravel()
        signs = np.broadcast_to(np.asarray(sign, np.int64), digests.shape)
        np.add.at(self.count, at, np.tile(signs, PLACES))
        np.bitwise_xor.at(self.digest, at, np.tile(digests, PLACES))
        np.bitwise_xor.at(self.check, at, np.tile(_checks(digests), PLACES))
        return self

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n_docs, self.cells)
        out.count, out.digest, out.check = self.count - other.count, self.digest ^ other.digest, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests only in the first and only in the second, by document, and whether all were found."""
        more, less = np.zeros(self.n_docs, np.int64), np.zeros(self.n_docs, np.int64)
        for _ in range(len(self.count) + 1):
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_checks(self.digest[at]) == self.check[at]]
            if not len(at):
                break
            doc, digests, signs = at // self.cells, self.digest[at], self.count[at]
            # A digest alone in several cells is taken out once.
            order = np.lexsort((digests, doc))
            keep = np.ones(len(order), bool)
            keep[1:] = (digests[order][1:] != digests[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            doc, digests, signs = doc[order][keep], digests[order][keep], signs[order][keep]
            more += np.bincount(doc[signs > 0], minlength=self.n_docs)
            less += np.bincount(doc[signs < 0], minlength=self.n_docs)
            self.add(doc, digests, -signs)
        left = (self.count != 0) | (self.digest != 0)
        return more, less, ~left.reshape(self.n_docs, self.cells).any(axis=1)

    def strings(self, sizes: np.ndarray) -> list[str]:
        """A fingerprint per document: its number of paragraphs and its cells in base 64."""
        table = np.empty(len(self.count), _CELL)
        table["count"], table["check"], table["digest"] = self.count, self.check, self.digest
        raw, width = table.tobytes(), self.cells * _CELL.itemsize
        return [f"{n}:{base64.b64encode(raw[k * width : (k + 1) * width]).decode()}" for k, n in enumerate(sizes.tolist())]


def read_fingerprint(fingerprint: str) -> tuple[int, Sketches]:
    size, _, cells = fingerprint.partition(":")
    table = np.frombuffer(base64.b64decode(cells), _CELL)
    sketch = Sketches(1, len(table))
    sketch.count, sketch.check, sketch.digest = table["count"].astype(np.int64), table["check"].astype(np.uint64), table["digest"].copy()
    return int(size), sketch


def likeness(more: np.ndarray, less: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common paragraphs over all paragraphs of two documents; two empty ones are alike."""
    shared = sizes - more
    union = shared + more + less
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


def compare_fingerprints(a: str, b: str) -> float | None:
    """Likeness of two fingerprints, or None where they are too small for the difference."""
    (size, left), (_, right) = read_fingerprint(a), read_fingerprint(b)
    more, less, done = left.minus(right).peel()
    return float(likeness(more, less, np.array([size]))[0]) if done[0] else None


def _take(digests: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the chosen documents, and the place of each one's document among the chosen."""
    sizes = bounds[docs + 1] - bounds[docs]
    at = np.repeat(bounds[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return digests[at], np.repeat(np.arange(len(docs)), sizes)


def differences(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, cells: int = CELLS
) -> np.ndarray:
    """Likeness of document a[i] of `left` to document b[i] of `right`, retrying larger until all peel."""
    result = np.zeros(len(a))
    open_pairs = np.arange(len(a))
    while len(open_pairs):
        own, own_doc = _take(*left, a[open_pairs])
        other, other_doc = _take(*right, b[open_pairs])
        sketch = Sketches(len(open_pairs), cells).add(own_doc, own).minus(Sketches(len(open_pairs), cells).add(other_doc, other))
        more, less, done = sketch.peel()
        sizes = np.diff(left[1])[a[open_pairs]]
        result[open_pairs[done]] = likeness(more, less, sizes)[done]
        open_pairs = open_pairs[~done]
        cells *= _GROWTH
    return result


def fingerprint_texts(texts: list[str], cells: int = CELLS) -> list[str]:
    digests, bounds = paragraph_digests(texts)
    sizes = np.diff(bounds)
    return Sketches(len(texts), cells).add(np.repeat(np.arange(len(texts)), sizes), digests).strings(sizes)


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _describe(ids: list, texts: list[str], own: list[int], cells: int) -> pa.RecordBatch:
    """Rows for texts[i], i in `own`, whose following text is texts[i + 1]."""
    edited = [edited_text(texts[i], texts[i + 1]) for i in own]
    plain, changed = paragraph_digests(texts), paragraph_digests(edited)
    at = np.array(own, np.int64)
    row = np.arange(len(own))
    own_digests, own_doc = _take(*plain, at)
    sizes = np.diff(plain[1])[at]
    prints = Sketches(len(own), cells).add(own_doc, own_digests).strings(sizes)
    new_digests, new_doc = _take(*changed, row)
    new_prints = Sketches(len(own), cells).add(new_doc, new_digests).strings(np.diff(changed[1]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[i] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(prints),
            pa.array(new_prints),
            pa.array(differences(plain, changed, at, row, cells)),
            pa.array(differences(plain, plain, at, at + 1, cells)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def in_id_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(range, borrowed, doc_id, text) sorted by id in each range, each range's first row lent to the one before.

    Ranges are cut at approximate quantiles of the ids; the first id of every range is found
    in a scan of the ids alone. The rows with it travel twice, so that the last row of the
    range before (of the last range, for the first one) finds its successor. Texts are shuffled once.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("order"))
    n_ranges = max(-(-docs.count() // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.approxQuantile("order", [k / n_ranges for k in range(1, n_ranges)], 0.25 / n_ranges) if n_ranges > 1 else []
    # As whole numbers the cuts keep the order of all ids.
    cuts = np.unique(np.array([int(c) if c < 2**63 else 2**63 - 1 for c in cuts], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.sort(batch.column("order").to_numpy(zero_copy_only=False))
            bucket = np.searchsorted(cuts, order, side="right")
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(order[first])], names=["range", "first"])

    found = ids.mapInArrow(least, "range long, first long").groupBy("range").agg(F.min("first").alias("first"))
    heads = sorted((r["range"], r["first"]) for r in found.collect())  # one row a range
    lent = {first: heads[k - 1][0] for k, (_, first) in enumerate(heads)}
    firsts = np.array([first for _, first in heads], np.int64)
    lent_to = np.array([lent[first] for _, first in heads], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            order = batch.column("order").to_numpy(zero_copy_only=False)
            place = np.searchsorted(firsts, order)
            is_head = np.append(firsts, 0)[place] == order
            is_head &= place < len(firsts)
            rows = np.concatenate([np.arange(len(order)), np.flatnonzero(is_head)])
            target = np.concatenate([np.searchsorted(cuts, order, side="right"), lent_to[place[is_head]]])
            some = batch.take(pa.array(rows))
            borrowed = np.arange(len(rows)) >= len(order)
            yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(borrowed), *some.columns], names=["range", "borrowed", *some.schema.names])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("order"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    dealt = rows.mapInArrow(deal, "range long, borrowed boolean, order long, doc_id long, text string")
    placed = dealt.repartitionById(n_ranges, F.col("range").cast("int"))
    return placed.sortWithinPartitions("range", "borrowed", "order", F.crc32(F.encode("text", "UTF-8")))


def fingerprint_documents(docs: DataFrame, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the fingerprints of its text and of its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null texts are empty. The next document is the one with the next larger id
    (after the last: the first, so a single document follows itself); null ids come before all
    others and rows with equal ids are ordered by a checksum of their text. Other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple | None = None  # the last row so far, still without a successor
        for batch in slices(batches, "text"):
            rows = list(zip(*[batch.column(c).to_pylist() for c in ("range", "borrowed", "doc_id", "text")], strict=True))
            if carried is not None:
                rows.insert(0, carried)
            own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            carried = rows[-1]
            if own:
                yield _describe([r[2] for r in rows], [r[3] for r in rows], own, cells)

    return in_id_order(docs, id_col, text_col).mapInArrow(run, _OUT)
