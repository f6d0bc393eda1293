"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaf of a symbol holds the rank of its pair with the next living symbol. The root leads to
the leftmost lowest-ranked pair; a merge changes two pairs, so two leaf-to-root paths, until no
pair can be merged. Texts are split at white space, distinct words are encoded once and
kept in a bounded cache, and the whole text's ids are put together from them.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import RunCache, coded, gather_ragged, slices, split_words

# A merge as one number: its rank above the symbol it makes, so numbers order as ranks do.
_SYMBOL_BITS = 20
_SYMBOL = (1 << _SYMBOL_BITS) - 1
_NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The visible character of each byte: printable Latin-1 bytes stay, others follow from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


def merge_table(merges: list[tuple[int, int, int]]) -> dict[int, int]:
    """(left << _SYMBOL_BITS | right) to (rank << _SYMBOL_BITS | made) for (left, right, made) in order of rank."""
    return {left << _SYMBOL_BITS | right: rank << _SYMBOL_BITS | made for rank, (left, right, made) in enumerate(merges)}


def merge_symbols(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Apply the lowest-ranked, leftmost merge until none is left."""
    n = len(ids)
    if n < 2:
        return ids
    pairs = [merges.get(a << _SYMBOL_BITS | b, _NONE) for a, b in zip(ids, ids[1:])]
    if n == 2:
        return [pairs[0] & _SYMBOL] if pairs[0] != _NONE else ids
    leaves = 1 << (n - 2).bit_length()
    tree = [_NONE] * leaves + pairs + [_NONE] * (leaves - n + 1)
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left <= right else right
    ids, following, previous = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(node: int, low: int) -> None:
        """Set a leaf; the way up ends at the first parent that keeps its value."""
        while tree[node] != low:
            tree[node] = low
            other = tree[node ^ 1]
            if other < low:
                low = other
            node >>= 1
            if not node:
                break

    while tree[1] != _NONE:
        node, low = 1, tree[1]
        while node < leaves:
            node *= 2
            if tree[node] != low:
                node += 1
        at = node - leaves
        made = ids[at] = low & _SYMBOL
        gone = following[at]
        after = following[at] = following[gone]
        if after < n:
            put(leaves + gone, _NONE)
            previous[after] = at
            put(node, merges.get(made << _SYMBOL_BITS | ids[after], _NONE))
        else:
            put(node, _NONE)
        before = previous[at]
        if before >= 0:
            put(leaves + before, merges.get(ids[before] << _SYMBOL_BITS | made, _NONE))
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = following[at]
    return out


class WordTokenizer:
    """Encodes and decodes like a tokenizer file with word-end symbols and byte-level pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.vocab = vocab
        self.merges = merge_table([(vocab[left], vocab[right], vocab[left + right]) for left, right in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {number: token for token, number in vocab.items()} | {v: k for k, v in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.symbols = byte_symbols()
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            symbols = [self.symbols[b] for b in piece.encode("utf-8")]
            symbols[-1] += self.end
            found = merge_symbols([self.vocab[s] for s in symbols], self.merges)
            if len(piece) <= 64:
                if len(self.pieces) > 400_000:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _plain(self, text: str) -> list[int]:
        text = unicodedata.normalize("NFC", text)
        # A final sigma depends on its neighbours in Python's lower(), not in the tokenizer's.
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # The pattern takes letters as one piece.
        if text.isalpha():
            return self._piece(text)
        return [i for piece in self.pattern.findall(text) for i in self._piece(piece)]

    def encode(self, text: str) -> list[int]:
        if "<" not in text:
            return self._plain(text)
        ids, at = [], 0
        for match in self.special_pattern.finditer(text):
            ids += self._plain(text[at : match.start()])
            ids.append(self.special[match.group()])
            at = match.end()
        return ids + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array<int>), decoded (string).

    Null and empty texts have no ids and decode to an empty string. Texts are encoded whole,
    whatever their length; ties between merges go to the leftmost pair; repeated rows and null
    ids stay rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            runs = [tokenizer.encode(w) for w in words]
            lengths = np.array([len(r) for r in runs], np.int64)
            return np.fromiter(chain.from_iterable(runs), np.int64, int(lengths.sum())), lengths

        cache = RunCache(encode_words)
        names = pa.array([tokenizer.tokens.get(i, "") for i in range(max(tokenizer.tokens) + 1)])
        for batch in slices(batches, "text"):
            words, bounds = split_words(batch.column("text"))
            codes, distinct = coded(words)
            flat, starts, lengths = cache.runs(distinct)
            ids = gather_ragged(flat, starts[codes], lengths[codes]) if len(codes) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths[codes])])[bounds]
            offsets = pa.array(ends, pa.int32())
            ids = pa.array(ids, pa.int32())
            decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(ids)), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, ids), decoded], names=["doc_id", "ids", "decoded"]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, joined by a space) and of the text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
