"""Quality rules: base counts and an n-gram likelihood ratio of trusted text to the whole corpus.

Words and runs of symbols, single and in neighbouring pairs, are hashed into `BUCKETS`. The
counts over the documents labelled good and over all documents give two multinomials. Each bucket
of the raw one gets `PRIOR` more counts, and of the target its share of them, so a bucket that is rare in
the corpus says little, however many buckets there are. A document's value is the mean logarithm
of their ratio over its n-grams, so its length does not matter; a document whose value is below
`MIN_RATIO` is rejected. All steps are SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.once import computed_once

BUCKETS = 1 << 16
PRIOR = 16.0
# Mean log ratio that a document must reach.
MIN_RATIO = -0.25
MIN_WORDS = 50
# Bytes up to which the ids of trusted documents are broadcast; beyond, they take a shuffle join.
BROADCAST_BYTES = 64 << 20
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def tokens_of(text: Column) -> Column:
    return words_of(F.regexp_replace(text, r"([^\p{L}\p{N}\x20\x09-\x0D]++)", " $1 "))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def buckets_of(hashes: Column, buckets: int) -> Column:
    """Buckets of the single tokens and of the neighbouring pairs, from the tokens' hashes."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(2), n), lambda a, b: bucket_of(F.xxhash64(a, b), buckets))
    return F.concat(F.transform(hashes, lambda h: bucket_of(h, buckets)), pairs)


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__rules_id")).distinct()


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, prior: float, id_col: str, text_col: str) -> DataFrame:
    """One row: `ratios`, the log ratio of the two smoothed shares of every bucket."""
    trusted = trusted_ids(labels)
    if trusted.count() * 16 <= BROADCAST_BYTES:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col(id_col).cast("long").alias("__rules_doc"), F.col(text_col).alias("__rules_text"))
    rows = rows.filter(F.col("__rules_text").isNotNull())
    rows = rows.join(trusted, F.col("__rules_doc") == F.col("__rules_id"), "left")
    rows = computed_once(rows, {"__rules_tokens": tokens_of(F.col("__rules_text"))})
    # The same buckets, but every token and the one after it become a row: generated code counts them.
    after = F.slice("__rules_tokens", 2, 1 << 30)
    zipped = F.arrays_zip(F.col("__rules_tokens").alias("token"), after.alias("next"))
    rows = rows.select(F.col("__rules_id").isNotNull().cast("long").alias("target"), F.explode(zipped).alias("p"))
    single, following = F.xxhash64("p.token"), F.xxhash64("p.next")
    pair = F.when(F.col("p.next").isNotNull(), bucket_of(F.xxhash64(single, following), buckets))
    both = F.array(F.struct(bucket_of(single, buckets).alias("bucket")), F.struct(pair.alias("bucket")))
    grams = rows.select("target", F.inline(both)).filter("bucket IS NOT NULL")
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    spark = docs.sparkSession
    # Every bucket has a row; from here on the table has `buckets` rows.
    counted = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left")
    counted = counted.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    listed = F.sort_array(F.collect_list(F.struct("bucket", "raw", "target")))
    total = counted.agg(listed.alias("cells"), F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    share = F.col("targets") / F.col("raws")
    ratio = lambda c: F.log((c["target"] + prior * share) / (c["raw"] + prior) / share)
    # Without trusted text there is nothing to compare with.
    return total.select(F.transform("cells", lambda c: F.when(F.col("targets") > 0, ratio(c)).otherwise(F.lit(0.0))).alias("ratios"))


def with_verdict(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    prior: float = PRIOR,
    min_ratio: float = MIN_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with one more column, `__rules`: a struct of the counts, `ratio` and the verdicts."""
    ratios = log_ratios(docs, labels, buckets, prior, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = computed_once(docs, {"__rules_text": text, "__rules_words": words_of(text), "__rules_tokens": hashes_of(tokens_of(text))})
    df = computed_once(df, {"__rules_hashes": hashes_of(F.col("__rules_words")), "__rules_buckets": buckets_of(F.col("__rules_tokens"), buckets)})
    n = F.size("__rules_hashes")
    at = lambda i: F.get(F.col("__rules_hashes"), i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    df = computed_once(df, {"__rules_windows": F.coalesce(windows, F.array().cast("array<bigint>"))})
    # Windows in order of their hash, only where one occurs twice.
    some = F.size(F.array_distinct("__rules_windows")) < F.size("__rules_windows")
    placed = F.sort_array(F.transform("__rules_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = computed_once(df, {"__rules_sorted": F.when(some, placed)})
    h = lambda j: F.get(F.col("__rules_sorted"), j)["h"]
    m = F.size("__rules_sorted")
    again = F.filter("__rules_sorted", lambda x, j: ((j > 0) & (h(j - 1) == x["h"])) | ((j < m - 1) & (h(j + 1) == x["h"])))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("__rules_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # The table of ratios is one value of fixed size that every task gets as a constant.
    df = df.withColumn("__rules_ratios", ratios.scalar())
    # Used once, so that the table stays a constant of the projection and is in no row.
    ratio_sum = F.aggregate("__rules_buckets", F.lit(0.0), lambda a, b: a + F.get(F.col("__rules_ratios"), b))
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "__rules_ratios"], ratio_sum.alias("__rules_sum"))
    df = computed_once(
        df,
        {
            "__rules_lines": lines,
            "__rules_repeat": F.coalesce(covered, F.lit(0)).cast("long"),
            "__rules_ratio": F.when(F.size("__rules_buckets") > 0, F.col("__rules_sum") / F.size("__rules_buckets")).otherwise(F.lit(0.0)),
        },
    )
    n_words = F.size("__rules_words").cast("long")
    failed = (n_words < MIN_WORDS) | (F.col("__rules_repeat") * 100 > n_words * 50)
    rules = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join("__rules_words", "")).cast("long").alias("word_chars"),
        (F.length("__rules_text") - F.length(F.regexp_replace("__rules_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__rules_lines") - F.size(F.array_distinct("__rules_lines"))).cast("long").alias("n_dup_lines"),
        F.col("__rules_repeat").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (F.col("__rules_ratio") >= min_ratio)).alias("kept"),
        F.col("__rules_ratio").alias("ratio"),
    )
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], rules.alias("__rules"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and ratio.

    Null and empty texts have no words and fail the base rule. A line counts as repeated for
    every occurrence after its first. Repeated rows and null ids stay rows; other columns are
    not read. Without documents labelled good, the base rule alone decides.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    judged = with_verdict(slim, labels, id_col="doc_id", text_col="text", **parameters)
    return judged.select("doc_id", "__rules.*")


def keep_passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they are."""
    judged = with_verdict(docs, labels, id_col=id_col, text_col=text_col, **parameters)
    return computed_once(judged, {"__rules_kept": F.col("__rules.kept")}).filter("__rules_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
