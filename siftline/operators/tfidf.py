"""TF-IDF as relations: (doc, term) rows, fitted vocabulary, weights with unit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions.once import computed_once
from siftline.functions.text import ngrams, word_tokens
from siftline.operators import lookup

# Bytes of text whose terms are counted in one task; a task's memory follows them, not the table.
PART_BYTES = 4 << 20


def tokenize(docs: DataFrame, doc: str, text: str, max_n: int = 1) -> DataFrame:
    """One row per token (or n-gram) occurrence: doc, term."""
    tokens = word_tokens(F.col(text))
    if max_n > 1:
        docs = computed_once(docs.select(doc, text), {"_tokens": tokens})
        tokens = ngrams(F.col("_tokens"), max_n)
    return docs.select(doc, F.explode(tokens).alias("term"))


def term_counts(docs: DataFrame, doc: str, text: str, max_n: int = 1) -> DataFrame:
    """doc, term, tf. The text is hashed on the document first, which is smaller than its
    exploded terms, and the count then needs no further exchange. Parts grow in number with
    the texts, not in size: one scan adds up their bytes."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    placed = docs.select(doc, text).repartition(parts, F.col(doc))
    return tokenize(placed, doc, text, max_n).groupBy(doc, "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: DataFrame, max_features: int | None = None) -> DataFrame:
    """term, df, corpus_count, idf from the fitted documents.

    `n_docs` is one row with the column n. With `max_features` only the terms with the
    highest corpus count stay, equal counts in term order.
    """
    terms = counts.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("corpus_count")
    )
    if max_features is not None:
        terms = terms.orderBy(F.desc("corpus_count"), "term").limit(max_features)
    n = n_docs.select("n").scalar()
    return terms.withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def weigh(
    counts: DataFrame, vocab: DataFrame, doc: str, target_rows: int = lookup.TARGET_ROWS
) -> DataFrame:
    """doc, term, tf, weight; terms outside the vocabulary vanish, every row has norm 1.

    Common words are a large share of the rows, so idf is attached with the heavy-key join.
    """
    dim = vocab.select("term", "df", "idf")
    rows = lookup.attach(counts, dim, "term", "df", spread=doc, how="inner", target_rows=target_rows)
    raw = rows.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(doc)))
    return raw.select(doc, "term", "tf", (F.col("_w") / norm).alias("weight"))


def fit_transform(
    docs: DataFrame, doc: str, text: str, max_n: int = 1, max_features: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, weights) of the documents the vocabulary is fitted on."""
    counts = term_counts(docs, doc, text, max_n)
    vocab = vocabulary(counts, document_count(docs), max_features)
    return vocab, weigh(counts, vocab, doc)


def transform(docs: DataFrame, vocab: DataFrame, doc: str, text: str, max_n: int = 1) -> DataFrame:
    """Weights of unseen documents under a fitted vocabulary."""
    return weigh(term_counts(docs, doc, text, max_n), vocab, doc)


def feature_counts(vocab: DataFrame, manual_features: int) -> DataFrame:
    """Vocabulary size, number of manual features and their total."""
    size = F.count("*")
    return vocab.agg(
        size.alias("tfidf_vocabulary_size"),
        F.lit(manual_features).alias("manual_feature_count"),
        (size + manual_features).alias("feature_count"),
    )
