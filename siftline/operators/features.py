"""The exact feature block: manual features, then one column per vocabulary term in term order.

A vocabulary stays a table. Its terms get dense numbers by counting ranges, so no list of
terms passes through the driver, and the vector of a row is put together from its own terms
in one aggregation. Several vocabularies (n-gram lengths, size limits) are fitted and applied
together: terms are counted once for the longest n-grams, and a row's terms meet all of them in one join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siftline import config as cfg
from siftline.functions.durable import durable
from siftline.operators import lookup, tfidf

FEATURES = "features"
_CELLS = "array<struct<index:int,value:double>>"


@dataclass(frozen=True)
class TextSetting:
    """Longest n-gram and largest number of terms of a vocabulary."""

    max_n: int = 1
    max_features: int | None = None


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add dense numbers from 0 in the ascending order of `order`, which is unique.

    Rows are dealt to ranges of the order and kept there; a number is the count of all
    ranges before the row's own plus its place inside it. One count per range meets in one task.
    """
    ranged = durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_place", place).join(F.broadcast(offsets), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def to_vector(size: int, cells: Column) -> Column:
    """Sparse MLlib vector of cells (index, value) in index order.

    SQL has no constructor of sparse vectors; reading one from JSON keeps every digit of a double.
    """
    parts = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.transform(cells, lambda c: c["index"]).alias("indices"),
        F.transform(cells, lambda c: c["value"]).alias("values"),
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]


def manual_cells(names: tuple[str, ...] = cfg.FEATURE_NAMES) -> Column:
    """Cells of the manual features that are not zero, indexes from 0."""
    cells = [F.struct(F.lit(k).alias("index"), F.col(name).cast("double").alias("value")) for k, name in enumerate(names)]
    return F.filter(F.array(*cells), lambda c: c["value"] != 0)


@dataclass(frozen=True)
class FeatureSpace:
    """Fitted vocabularies. `vocab`: setting, term, df, idf, index; `sizes`: terms of each setting."""

    settings: tuple[TextSetting, ...]
    vocab: DataFrame
    sizes: tuple[int, ...]
    id_col: str
    text: str

    def text_cells(self, rows: DataFrame) -> DataFrame:
        """id, setting, cells: the unit TF-IDF row of every text under every setting, in index order.

        A text without a known term has no row. Ids are unique.
        """
        longest = max(s.max_n for s in self.settings)
        counts = tfidf.term_counts(rows, self.id_col, self.text, longest)
        entries = F.collect_list(F.struct("setting", "index", "idf"))
        dim = self.vocab.groupBy("term").agg(entries.alias("_entries"), F.max("df").alias("df"))
        known = lookup.attach(counts, dim, "term", "df", spread=self.id_col, how="inner")
        each = known.select(self.id_col, "tf", F.inline("_entries"))
        cell = F.struct(F.col("index").cast("int").alias("index"), (F.col("tf") * F.col("idf")).alias("value"))
        grouped = each.groupBy(self.id_col, "setting").agg(F.sort_array(F.collect_list(cell)).alias("_raw"))
        norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, c: total + c["value"] * c["value"]))
        scaled = F.transform("_raw", lambda c: F.struct(c["index"].alias("index"), (c["value"] / F.col("_norm")).alias("value")))
        return grouped.withColumn("_norm", norm).select(self.id_col, "setting", scaled.alias("cells"))

    def size(self, setting: TextSetting | None, manual: tuple[str, ...]) -> int:
        return len(manual) + (0 if setting is None else self.sizes[self.settings.index(setting)])

    def vectors(
        self,
        rows: DataFrame,
        setting: TextSetting | None,
        manual: tuple[str, ...] = cfg.FEATURE_NAMES,
        cells: DataFrame | None = None,
    ) -> DataFrame:
        """Rows with `features`: manual ones first, then the text block of `setting` (None: no text).

        `cells` are the stored text cells of these rows, if there are any.
        """
        own = manual_cells(manual) if manual else F.array().cast(_CELLS)
        if setting is None:
            return rows.withColumn(FEATURES, to_vector(self.size(None, manual), own))
        cells = self.text_cells(rows) if cells is None else cells
        wanted = cells.filter(F.col("setting") == self.settings.index(setting)).select(self.id_col, F.col("cells").alias("_cells"))
        shifted = F.transform("_cells", lambda c: F.struct((c["index"] + len(manual)).alias("index"), c["value"].alias("value")))
        whole = F.concat(own, F.coalesce(shifted, F.array().cast(_CELLS)))
        joined = rows.join(wanted, self.id_col, "left")
        return joined.withColumn(FEATURES, to_vector(self.size(setting, manual), whole)).drop("_cells")


def fit_space(
    train: DataFrame, settings: tuple[TextSetting, ...] = (TextSetting(),), id_col: str = "line_id", text: str = "message"
) -> FeatureSpace:
    """Vocabularies of all settings from one count of the training texts.

    With `max_features` the terms of the highest corpus count stay, equal counts in term order.
    Only the number of terms of each setting reaches the driver.
    """
    settings = tuple(dict.fromkeys(settings))
    counts = tfidf.term_counts(train, id_col, text, max(s.max_n for s in settings))
    terms = durable(tfidf.vocabulary(counts, tfidf.document_count(train)))
    # A token holds no blank, so blanks tell the length of an n-gram.
    length = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit(""))) + 1
    tagged = []
    for k, setting in enumerate(settings):
        own = terms.filter(length <= setting.max_n)
        if setting.max_features is not None:
            own = own.orderBy(F.desc("corpus_count"), "term").limit(setting.max_features)
        tagged.append(own.select(F.lit(k).alias("setting"), "term", "df", "idf"))
    every = durable(numbered(reduce(DataFrame.unionByName, tagged), ["setting", "term"], "_number"))
    # One row per setting: where its numbers start, and how many there are.
    first = every.groupBy("setting").agg(F.min("_number").alias("_first"), F.count("*").alias("n"))
    sizes = {r["setting"]: r["n"] for r in first.collect()}
    vocab = every.join(F.broadcast(first.select("setting", "_first")), "setting")
    vocab = vocab.select("setting", "term", "df", "idf", (F.col("_number") - F.col("_first")).alias("index"))
    return FeatureSpace(settings, vocab, tuple(sizes.get(k, 0) for k in range(len(settings))), id_col, text)
