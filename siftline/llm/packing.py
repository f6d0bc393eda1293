"""Packing token sequences into fixed windows by best-fit decreasing.

Every document is tokenised whole and closed with an end id. Full windows are cut off first;
each document leaves at most one shorter remainder. Remainders are dealt to groups of about
`group_docs` documents by hash; inside a group they are placed longest first into the open
window with the least sufficient room, which a segment tree over remaining capacities finds.
Groups are packed independently, so no task sees more than its group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import RunCache, gather_ragged, slices

WINDOW = 2048
GROUP_DOCS = 8192


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaf c counts windows with room c."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, number: int) -> None:
        self.at[room].append(number)
        node = room + self.leaves
        while node:
            self.filled[node] += 1
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out the window with the least room of at least `length`: (room, number)."""
        filled, node = self.filled, length + self.leaves
        if not filled[node]:
            while node > 1 and (node & 1 or not filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not filled[node]:
                    node += 1
        room = node - self.leaves
        while node:
            filled[node] -= 1
            node >>= 1
        return room, self.at[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length (1 .. window); ties keep their order."""
    numbers = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    tree, opened = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.tightest(length) if length < window else None
        room, number = found or (window, opened)
        opened += found is None
        numbers[i], offsets[i] = number, window - room
        if room > length:
            tree.add(room - length, number)
    return numbers, offsets


_WHITE = r"[\x09-\x0d\x1c-\x20\x{85}\pZ]"
_ODD_HEAD = rf"^\z|{_WHITE}\z"
_ODD_PART = rf"{_ODD_HEAD}|^{_WHITE}"


def _matching(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


class Encoder:
    """Token ids of many texts, exactly as the tokenizer gives them for each whole text.

    A byte-level pre-tokenizer never joins characters across a space that stands alone between
    two other characters, so a text is the sequence of its space-separated parts, each but the
    first with its leading space. Distinct parts are encoded once, all in one call; texts where
    a part is empty or touches other white space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.opens = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.opens[number] = token.startswith("Ġ")
        self.parts = RunCache(self._encode_parts)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, lengths = [], []
        for k in range(0, len(parts), 20_000):
            some = parts[k : k + 20_000]
            ids = self.whole(" " + " ".join(some))
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(some) or starts[0]:
                runs = [self.whole(" " + part) for part in some]
                ids, counts = np.concatenate(runs), np.array([len(r) for r in runs], np.int64)
            else:
                counts = np.diff(np.append(starts, len(ids)))
            flat.append(ids)
            lengths.append(counts)
        return np.concatenate(flat), np.concatenate(lengths)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by `end_id`, and the ends of the texts."""
        lists = pc.split_pattern(texts, " ")
        parts = lists.flatten()
        bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = bounds - bounds[0]
        found = parts.dictionary_encode()
        codes, distinct = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        words = distinct.to_pylist()
        odd = _matching(distinct, _ODD_PART)
        is_first = np.zeros(len(codes), bool)
        is_first[bounds[:-1]] = True
        rest = np.zeros(len(words), bool)
        rest[codes[~is_first]] = True
        usable = rest & ~odd
        flat, starts, lengths = self.parts.runs([w for w, u in zip(words, usable, strict=True) if u])
        word_starts, word_lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        word_starts[usable], word_lengths[usable] = starts, lengths

        n_docs = len(texts)
        odd_parts = np.add.reduceat((odd[codes] & ~is_first).astype(np.int64), bounds[:-1]) if n_docs else np.zeros(0)
        single = np.diff(bounds) == 1
        first_odd = _matching(distinct.take(pa.array(codes[bounds[:-1]])), _ODD_HEAD)
        direct = (odd_parts > 0) | (first_odd & ~single)
        heads = [
            self.whole(texts[d].as_py()) if direct[d] else self.whole(words[codes[bounds[d]]])
            for d in range(n_docs)
        ]
        # One run list: for each document its head, its other parts, the end id.
        tail = np.concatenate([*heads, np.array([end_id])]) if n_docs else np.array([end_id])
        pool = np.concatenate([flat, tail])
        head_lengths = np.array([len(h) for h in heads], np.int64)
        head_starts = len(flat) + np.cumsum(head_lengths) - head_lengths
        doc = np.repeat(np.arange(n_docs), np.diff(bounds))
        part_starts = np.where(is_first, head_starts[doc], word_starts[codes])
        part_lengths = np.where(is_first, head_lengths[doc], np.where(direct[doc], 0, word_lengths[codes]))
        places = bounds[1:] + np.arange(n_docs)
        all_starts = np.full(len(codes) + n_docs, len(pool) - 1, np.int64)
        all_lengths = np.ones(len(codes) + n_docs, np.int64)
        own = np.ones(len(all_starts), bool)
        own[places] = False
        all_starts[own], all_lengths[own] = part_starts, part_lengths
        return gather_ragged(pool, all_starts, all_lengths), np.cumsum(all_lengths)[places]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per full window and per remainder of each tokenised document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in slices(batches, "text"):
            ids, ends = encoder.encode(pc.fill_null(batch.column("text"), ""), end_id)
            ids = ids.astype("<u4")
            begins = np.concatenate([[0], ends[:-1]])
            totals = ends - begins
            counts = -(-totals // window)
            doc = np.repeat(np.arange(len(ends)), counts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
            length = np.minimum(window, totals[doc] - start)
            at = begins[doc] + start
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(totals[doc])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(cut, PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = 1,
    group_docs: int = GROUP_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one: its only token is the end id. Repeated rows are packed each
    on its own; documents of any length are cut into windows; an empty table gives no rows.
    Group and sequence numbers depend on ids and tokens only, so a retried task repeats them.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = token_pieces(docs, tokenizer_path, window, end_id, id_col, text_col)
    key = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    pieces = pieces.withColumn("group", F.pmod(key, F.lit(groups)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], ignore_index=True)
        numbers, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = rows["group"].to_numpy() * (1 << 32) + numbers
        rows["offset"] = offsets
        return rows.drop(columns="group").astype({"doc_id": "Int64"})

    return pieces.groupBy("group").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
