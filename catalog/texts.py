"""Queries over documents (TF-IDF) and the stratified split of labelled log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs
from catalog.oracle_base import define, query
from catalog.registry import register
from siftline import config as cfg
from siftline.operators import parse, split, tfidf

DOC, TEXT = "doc_id", "text"
MAX_FEATURES = 2_000
LANGUAGES = 64  # upper bound on the number of languages a document table tells apart

define(
    "toks",
    (),
    r"SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM documents",
)
define("occurrences", ("toks",), "SELECT doc_id, unnest(t) AS term FROM toks")
define(
    "grams",
    ("toks",),
    "SELECT doc_id, unnest(t) AS term FROM toks UNION ALL "
    "SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks",
)
define("tf", ("occurrences",), "SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL")
define(
    "vocab",
    ("tf",),
    "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_count, "
    "ln((1e0 + (SELECT count(*) FROM documents)) / (1e0 + count(*))) + 1e0 AS idf FROM tf GROUP BY term",
)
define("weighted", ("tf", "vocab"), "SELECT doc_id, term, tf, tf * idf AS w FROM tf JOIN vocab USING (term)")
define(
    "doc_split",
    (),
    """SELECT *, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id)
      <= ceil(0.4e0 * count(*) OVER (PARTITION BY lang)) THEN 'test' ELSE 'train' END AS split FROM documents""",
)
define(
    "split_tf",
    ("doc_split", "tf"),
    "SELECT doc_id, term, tf, split FROM tf JOIN doc_split USING (doc_id)",
)
define(
    "train_vocab",
    ("split_tf", "doc_split"),
    "SELECT term, ln((1e0 + (SELECT count(*) FROM doc_split WHERE split = 'train')) / (1e0 + count(*))) + 1e0 AS idf "
    "FROM split_tf WHERE split = 'train' GROUP BY term",
)
define(
    "line_split",
    ("usable",),
    """SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42|' || CAST(line_id AS VARCHAR)), line_id)
      <= ceil(0.4e0 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS split FROM usable""",
)


def _docs(spark, sf):
    return inputs.table(spark, sf, "documents")


@register(
    "t1_tokenize",
    query("SELECT doc_id, term, count(*) AS occurrences FROM occurrences GROUP BY ALL", "occurrences"),
)
def t1(spark, sf):
    return tfidf.term_counts(_docs(spark, sf), DOC, TEXT).withColumnRenamed("tf", "occurrences")


@register(
    "t2_ngrams",
    query("SELECT term, count(*) AS occurrences FROM grams GROUP BY ALL", "grams"),
)
def t2(spark, sf):
    grams = tfidf.term_counts(_docs(spark, sf), DOC, TEXT, max_n=2)
    return grams.groupBy("term").agg(F.sum("tf").alias("occurrences"))


@register(
    "t3_vocabulary",
    query("SELECT term, df, corpus_count, round(idf, 6) AS idf FROM vocab", "vocab"),
)
def t3_vocabulary(spark, sf):
    docs = _docs(spark, sf)
    counts = tfidf.term_counts(docs, DOC, TEXT)
    vocab = tfidf.vocabulary(counts, tfidf.document_count(docs))
    return vocab.withColumn("idf", F.round("idf", 6))


@register(
    "t3_tfidf_fit",
    query(
        "SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM weighted",
        "weighted",
    ),
)
def t3(spark, sf):
    _, weights = tfidf.fit_transform(_docs(spark, sf), DOC, TEXT)
    return weights.withColumn("weight", F.round("weight", 6))


@register(
    "t4_tfidf_transform",
    query(
        """SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM
        (SELECT doc_id, term, tf, tf * idf AS w FROM split_tf JOIN train_vocab USING (term) WHERE split = 'test')""",
        "split_tf",
        "train_vocab",
    ),
)
def t4(spark, sf):
    docs = split.stratified_split(_docs(spark, sf), "lang", DOC, LANGUAGES)
    train, test = docs.filter("split = 'train'"), docs.filter("split = 'test'")
    vocab = tfidf.vocabulary(tfidf.term_counts(train, DOC, TEXT), tfidf.document_count(train))
    return tfidf.transform(test, vocab, DOC, TEXT).withColumn("weight", F.round("weight", 6))


@register(
    "t5_max_features",
    query(
        f"SELECT term, df, corpus_count, round(idf, 6) AS idf FROM vocab ORDER BY corpus_count DESC, term LIMIT {MAX_FEATURES}",
        "vocab",
    ),
)
def t5(spark, sf):
    docs = _docs(spark, sf)
    counts = tfidf.term_counts(docs, DOC, TEXT)
    vocab = tfidf.vocabulary(counts, tfidf.document_count(docs), MAX_FEATURES)
    return vocab.withColumn("idf", F.round("idf", 6))


@register(
    "t6_vocabulary_size",
    query(
        "SELECT count(DISTINCT term) AS tfidf_vocabulary_size, 12 AS manual_feature_count, "
        "count(DISTINCT term) + 12 AS feature_count FROM occurrences",
        "occurrences",
    ),
)
def t6(spark, sf):
    docs = _docs(spark, sf)
    terms = tfidf.tokenize(docs, DOC, TEXT).select("term").distinct()
    return tfidf.feature_counts(terms, len(cfg.FEATURE_NAMES))


def line_split(spark, sf):
    rows = parse.usable_rows(parse.training_rows(inputs.log_lines(spark, sf)))
    settings = cfg.TrainingSettings()
    return split.stratified_split(
        rows, "label", "line_id", len(cfg.KNOWN_ACTIONS), settings.test_share, settings.seed
    )


@register("d1_stratified_split", query("SELECT line_id, label, split FROM line_split", "line_split"))
def d1(spark, sf):
    return line_split(spark, sf).select("line_id", "label", "split")


@register(
    "d1_split_documents", query("SELECT doc_id, lang, split FROM doc_split", "doc_split")
)
def d1_documents(spark, sf):
    docs = _docs(spark, sf).select(DOC, "lang")
    return split.stratified_split(docs, "lang", DOC, LANGUAGES).select(DOC, "lang", "split")


define(
    "hashed",
    ("line_split",),
    "SELECT split, sha256(raw_log || '|' || message || '|' || CAST(label AS VARCHAR)) AS h FROM line_split",
)
_LANES = " || '|' || ".join(
    f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) AS VARCHAR)" for i in range(8)
)


@register(
    "d2_split_fingerprint",
    query(
        f"""SELECT tr.n AS train_size, tr.fp AS train_split_sha256, te.n AS test_size, te.fp AS test_split_sha256,
          sha256(tr.fp || '|' || te.fp) AS split_sha256 FROM
          (SELECT count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || '|' || {_LANES}) AS fp FROM hashed WHERE split = 'train') tr,
          (SELECT count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || '|' || {_LANES}) AS fp FROM hashed WHERE split = 'test') te""",
        "hashed",
    ),
)
def d2(spark, sf):
    return split.split_fingerprint(line_split(spark, sf), "raw_log", "message", "label")
