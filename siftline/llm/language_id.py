"""Language identification by rank-order profiles of character n-grams.

A profile lists the `PROFILE` most frequent n-grams (one to three characters, letters in lower
case, everything else read as one space) by rank. A text gets the language whose profile is
nearest by out-of-place distance: for every n-gram of the text's profile the difference of the
two ranks, or `PROFILE` where the language lacks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.llm.common import held_out, slices

PROFILE = 300
ORDERS = 3
# Documents per language that learning reads, in expectation; each is chosen by its hashed id.
MAX_PER_LANGUAGE = 4_000
_POINT_BITS = 21
_SLICE_DOCS = 2_048


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (0 for a space) of all texts, document of each, and whether a text has letters.

    Every text is closed by a space; runs of other characters than letters are one space.
    """
    values = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    points = np.frombuffer("\n".join([*values, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(values)), lengths + 1)
    used, codes = np.unique(points, return_inverse=True) if points.max(initial=0) > 0xFFFF else (None, None)
    if used is None:
        present = np.flatnonzero(np.bincount(points, minlength=1))
        alpha = np.zeros(0x10000, bool)
        alpha[[c for c in present.tolist() if chr(c).isalpha()]] = True
        is_letter = alpha[points]
    else:
        is_letter = np.fromiter((chr(c).isalpha() for c in used.tolist()), bool, len(used))[codes]
    points[~is_letter] = 0
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of each run of spaces the first one that follows a letter
    has_letter = np.zeros(len(values), bool)
    has_letter[doc[is_letter]] = True
    return points[keep], doc[keep], has_letter


def count_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of all texts by document, then n-gram; and which texts have letters.

    An n-gram is a number: its code points, 21 bits each, filled with ones behind its end, so that
    a space counts as a character.
    """
    points, doc, has_letter = _letters(texts)
    if not len(points):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, has_letter
    # Dense codes keep document and n-gram in one sortable number: 0 is "no character".
    alphabet = np.unique(points)
    code = np.searchsorted(alphabet, points) + 1
    width = int(len(alphabet)).bit_length()
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    # A space stands before each text.
    space = int(np.searchsorted(alphabet, 0)) + 1
    code = np.insert(code, starts, space)
    doc = np.insert(doc, starts, doc[starts])
    top = np.empty(len(alphabet) + 1, np.int64)
    top[1:] = alphabet
    top[0] = (1 << _POINT_BITS) - 1
    if int(doc[-1]).bit_length() + ORDERS * width > 63:
        raise OverflowError("too many documents for their alphabet")
    keys, counts = [], []
    gram = doc.copy()
    for order in range(ORDERS):
        reach = len(code) - order
        gram = (gram[:reach] << width) | code[order:]
        inside = doc[:reach] == doc[order:] if order else code != space
        own = np.sort(gram[inside] << (width * (ORDERS - 1 - order)))
        first = np.flatnonzero(np.diff(own, prepend=-1))
        keys.append(own[first])
        counts.append(np.diff(np.append(first, len(own))))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")  # three sorted runs
    keys, counts = keys[order], counts[order]
    mask = (1 << width) - 1
    grams = np.zeros(len(keys), np.int64)
    for k in range(ORDERS):
        grams = (grams << _POINT_BITS) | top[(keys >> (width * (ORDERS - 1 - k))) & mask]
    return keys >> (width * ORDERS), grams, counts, has_letter


def ranked(doc: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the `limit` most frequent n-grams of each document, in order, and their ranks.

    Rows come by document; ties keep the row order, which is that of the n-grams.
    """
    if not len(doc):
        return doc, doc
    count_bits, row_bits = int(counts.max()).bit_length(), len(doc).bit_length()
    if int(doc[-1]).bit_length() + count_bits + row_bits <= 63:
        packed = (((doc << count_bits) | ((1 << count_bits) - 1 - counts)) << row_bits) | np.arange(len(doc))
        rows = np.sort(packed) & ((1 << row_bits) - 1)
    else:
        rows = np.lexsort((-counts, doc))
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    rank = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    kept = rank < limit
    return rows[kept], rank[kept]


def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices small enough for document and n-gram to share a number."""
    for batch in slices(batches, "text"):
        for start in range(0, batch.num_rows, _SLICE_DOCS):
            some = batch.slice(start, _SLICE_DOCS)
            points = len({c for v in some.column("text").to_pylist() if v and not v.isascii() for c in set(v)}) + 128
            if _SLICE_DOCS.bit_length() + ORDERS * points.bit_length() <= 63:
                yield some
            else:
                for row in range(some.num_rows):
                    yield some.slice(row, 1)


def learn_profiles(
    docs: DataFrame,
    profile: int = PROFILE,
    max_per_language: int = MAX_PER_LANGUAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, list[int]]:
    """The n-grams of each language by rank, learned from documents that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    chance = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(sizes), "lang")  # one row per language
    sample = sample.filter(chance * F.col("rows") < max_per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            doc, grams, counts, _ = count_ngrams(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            number = coded.indices.to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((grams, number))
            number, grams, counts = number[order], grams[order], counts[order]
            first = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(grams, prepend=-1) != 0))
            totals = np.add.reduceat(counts, first) if len(first) else counts
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(number[first])), pa.array(grams[first]), pa.array(totals)], names=["lang", "gram", "n"]
            )

    totals = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = totals.withColumn("rank", best).filter(F.col("rank") <= profile).orderBy("lang", "rank")
    profiles: dict[str, list[int]] = {}
    for row in kept.collect():  # `profile` rows a language
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def identify_languages(
    docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The score is one less the best distance over the largest possible one. Texts that are null
    or have no letter, and all texts if nothing was learned, give `und` with score 0. Equal
    distances go to the language first by name. Texts count whole; repeated rows and null ids
    stay rows; other columns are not read.
    """
    names = sorted(profiles)
    grams = np.unique(np.array([g for n in names for g in profiles[n]], np.int64))
    ranks = np.full((len(names), len(grams) + 1), -1, np.int64)
    for k, name in enumerate(names):
        ranks[k, np.searchsorted(grams, profiles[name])] = np.arange(len(profiles[name]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in narrow(batches):
            n = batch.num_rows
            doc, found, counts, has_letter = count_ngrams(batch.column("text"))
            rows, rank = ranked(doc, counts, profile)
            doc, found = doc[rows], found[rows]
            known = len(names) > 0
            at = np.searchsorted(grams, found) if known else np.zeros(len(found), np.int64)
            hit = (np.append(grams, -1)[at] == found) if known else np.zeros(len(found), bool)
            distance = np.full((len(names), n), np.inf)
            sizes = np.bincount(doc, minlength=n)
            for k in range(len(names)):
                place = ranks[k, np.where(hit, at, len(grams))]
                out = np.where(place < 0, profile, np.abs(place - rank))
                distance[k] = np.bincount(doc, weights=out, minlength=n)
            best = distance.argmin(axis=0) if known else np.zeros(n, np.int64)
            usable = has_letter & known
            labels = [names[b] if u else "und" for b, u in zip(best.tolist(), usable.tolist(), strict=True)]
            near = distance[best, np.arange(n)] if known else np.zeros(n)
            score = np.where(usable, 1.0 - near / np.maximum(1, profile * sizes), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    predicted = slim.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
