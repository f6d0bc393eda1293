"""Personal data by candidate gradient boosting, in SQL functions only.

Base rules give the sure spans (email, ip, card, phone). High-recall generators propose further
spans that may overlap each other and the base: written-out addresses, telephone numbers without
a plus, account numbers and long numbers. Boosted trees score each by its format and the text
beside it. They are fitted on the candidates of all documents, in which a base rule or a check sum
labels some. That evidence is no feature, and its lack no proof: a card number with a mistyped or made-up digit fails
the check sum, a telephone number may lack its plus. So the labelled candidates count as some of the
positive ones, and what the trees learn is the chance of a label. For each generator the mean
chance of labelled candidates in documents kept aside calibrates it: a candidate that reaches
`MIN_SHARE` of that looks like the labelled ones, and is added if it touches no base span. The trees run
as one SQL expression per row, so scanning needs neither a shuffle nor Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.once import computed_once
from siftline.llm.common import written

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("email_like", "phone_like", "account", "number_like")
KINDS = BASE_KINDS + ADDED_KINDS

# The base patterns, written so that no match backtracks over a long run: a run is tried at its
# start or right after the match before it, which finds the same leftmost matches.
_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email_like": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "phone_like": r"(?<![0-9A-Za-z.])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "number_like": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){8,18}(?![0-9A-Za-z])",
}
PHONE_DIGITS = (7, 15)
SUPPORT = {"email_like": "email", "phone_like": "phone", "number_like": "card"}
_DIGIT, _AT = "[0-9]", r"@|\(at\)|\[at\]"

TREES, DEPTH = 10, 3
# Share of the labelled candidates' mean score that a candidate has to reach, and labelled ones
# that a generator needs in the documents kept aside.
MIN_SHARE, MIN_LABELLED = 0.5, 1
CONTEXT = 24

# Words beside a candidate that speak for or against it.
CONTEXT_WORDS = {
    "near_phone": r"tel|phone|call|fax|mobil|móvil|ruf|appel",
    "near_mail": r"mail|contact|write|kontakt|contacto|@",
    "near_account": r"iban|konto|account|card|karte|carte|tarjeta|visa|bank",
    "near_other": r"version|order|page|seite|token|hash|isbn|#|=|§|\bid\b|\bno\b",
}


# Matches that are placed one after another; longer lists are placed chunk by chunk.
_CHUNK = 64


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunk(items: Column, j: Column) -> Column:
    return F.slice(items, j * _CHUNK + 1, F.lit(_CHUNK))


def _chunks(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / _CHUNK).cast("int")
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


_SPANS = "array<struct<kind:string,start:int,end:int,match:string,left:string,right:string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points, with the matched text and its context.

    The context is `CONTEXT` characters before, back to the match before at most, and one after.
    The text between matches and the matches alternate, so adding up their lengths gives the positions:
    first over chunks of matches, then inside each chunk, so the work grows with the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = lambda gaps: F.arrays_zip(gaps.alias("gap"), found.alias("match"), F.slice(gaps, 2, 1 << 30).alias("after"))
    parts = F.filter(once(F.split(text, pattern, -1), zipped), lambda p: p["match"].isNotNull())
    length = lambda p: F.length(p["gap"]) + F.length(p["match"])

    def starts(parts: Column) -> Column:
        sums = F.transform(_chunks(parts), lambda j: F.aggregate(_chunk(parts, j), F.lit(0), lambda n, p: n + length(p)))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        return F.aggregate(sums, begin, step, lambda a: a["all"])

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), part["match"].alias("match"), F.right(part["gap"], F.lit(CONTEXT)).alias("left"), F.left(part["after"], F.lit(1)).alias("right"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(parts: Column, at: Column) -> Column:
        begin = lambda j: F.struct(F.get(at, j).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.flatten(F.transform(_chunks(parts), lambda j: F.aggregate(_chunk(parts, j), begin(j), add, lambda s: s["spans"])))

    return once(parts, lambda p: once(starts(p), lambda at: placed(p, at)))


def untouched(found: Column, base: Column) -> Column:
    """The spans of `found` that touch none of `base`; a chunk is compared only with base spans in its range."""

    def of_chunk(spans: Column) -> Column:
        first, last = F.array_min(F.transform(spans, lambda s: s["start"])), F.array_max(F.transform(spans, lambda s: s["end"]))
        bounds = F.struct(first.alias("start"), last.alias("end"))
        near = once(bounds, lambda r: F.filter(base, lambda b: _touches(b, r)))
        return once(near, lambda few: F.filter(spans, lambda s: ~F.exists(few, lambda b: _touches(b, s))))

    return F.flatten(F.transform(_chunks(found), lambda j: once(_chunk(found, j), of_chunk)))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        v = turned.substr(i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """True if the check digits of an account number written like an IBAN fit."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = turned.substr(i, F.lit(1))
        return F.when(c.rlike(_DIGIT), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def base_spans(text: Column) -> Column:
    def parts_fit(span: Column) -> Column:
        number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(span["match"], r"\."), lambda p: (F.length(number(p)) <= 3) & (number(p).substr(1, 3).cast("int") <= 255))

    def in_range(span: Column, low: int, high: int) -> Column:
        return F.length(digits_of(span["match"])).between(low, high)

    none = F.array().cast(_SPANS)
    of = lambda kind: matches(text, BASE_PATTERNS[kind], kind)
    numbers = F.concat(
        F.filter(of("ip"), parts_fit),
        F.filter(of("card"), lambda s: in_range(s, 14, 19) & luhn(digits_of(s["match"]))),
    )
    return F.concat(
        F.when(F.contains(text, F.lit("@")), of("email")).otherwise(none),
        F.when(text.rlike(_DIGIT), numbers).otherwise(none),
        F.when(F.contains(text, F.lit("+")), F.filter(of("phone"), lambda s: in_range(s, 10, 15))).otherwise(none),
    )


def candidates(text: Column) -> Column:
    none = F.array().cast(_SPANS)
    of = lambda kind: matches(text, GENERATORS[kind], kind)
    numbers = F.filter(of("phone_like"), lambda s: F.length(digits_of(s["match"])).between(*PHONE_DIGITS))
    return F.concat(
        F.when(text.rlike(_AT), of("email_like")).otherwise(none),
        F.when(text.rlike(_DIGIT), F.concat(numbers, of("account"), of("number_like"))).otherwise(none),
    )


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def feature_columns(span: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers. What labels are taken from (plus, check digits) is no feature."""
    match, digits = span["match"], digits_of(span["match"])
    flag = lambda c: c.cast("double")
    count = lambda pattern: (F.length(match) - F.length(F.regexp_replace(match, pattern, ""))).cast("double")
    left, right = F.lower(span["left"]), span["right"]
    groups = F.filter(F.split(match, "[^0-9]+"), lambda g: g != "")
    columns = {f"is_{kind}": flag(span["kind"] == kind) for kind in ADDED_KINDS}
    columns |= {
        "length": F.length(match).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": count("[A-Za-z]"),
        "spaces": count(" "),
        "dashes": count("[-/]"),
        "dots": count(r"\."),
        "brackets": count(r"[()\[\]]"),
        "groups": F.size(groups).cast("double"),
        "last_group": F.coalesce(F.length(F.element_at(F.concat(F.array(F.lit("")), groups), -1)), F.lit(0)).cast("double"),
        "follows_word": flag(left.rlike("[a-z0-9]$")),
        "before_word": flag(right.rlike("[A-Za-z0-9]")),
    }
    return columns | {name: flag(left.rlike(words)) for name, words in CONTEXT_WORDS.items()}


FEATURES = [
    *[f"is_{kind}" for kind in ADDED_KINDS], "length", "digits", "letters", "spaces", "dashes", "dots", "brackets", "groups",
    "last_group", "follows_word", "before_word", *CONTEXT_WORDS,
]


class Detector:
    """Fitted trees as nested (feature, threshold, left, right) or leaf values, and the thresholds."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, features: Column) -> Column:
        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(features[FEATURES[feature]] <= threshold, branch(left)).otherwise(branch(right))

        margin = reduce(lambda a, b: a + b, [branch(tree) * weight for weight, tree in self.trees], F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))


def _tree(node) -> object:
    if node.subtreeDepth() == 0:
        return node.prediction()
    split = node.split()
    return (split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


def fit_detector(
    docs: DataFrame, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> Detector | None:
    """Trees and thresholds from the candidates of all documents; None where a class is missing.

    A quarter of the documents, by hashed id and text, gives the thresholds and the others the trees.
    """
    rows = docs.select(F.xxhash64(F.lit(5), id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.filter(F.col("text").rlike(rf"{_DIGIT}|{_AT}"))
    rows = computed_once(rows, {"base": base_spans(F.col("text")), "found": candidates(F.col("text"))})
    rows = rows.select("key", "text", "base", F.explode("found").alias("span"))

    def touches_base(kind: str) -> Column:
        return F.exists("base", lambda b: (b["kind"] == kind) & _touches(b, F.col("span")))

    supported = F.lit(False)
    for kind, base in SUPPORT.items():
        supported = F.when(F.col("span.kind") == kind, touches_base(base)).otherwise(supported)
    features = feature_columns(F.col("span"))
    label = F.when(F.col("span.kind") == "account", mod97(F.col("span.match"))).otherwise(supported)
    table = rows.select("key", F.col("span.kind").alias("kind"), label.cast("double").alias("label"), *[c.alias(n) for n, c in features.items()])
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(written(table, "pii-candidates"))
    aside = F.pmod(F.shiftright("key", 32), F.lit(4)) == 0
    if table.filter(~aside).select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, minInstancesPerNode=5).fit(table.filter(~aside))
    roots = [(weight, _tree(tree._call_java("rootNode"))) for weight, tree in zip(model.treeWeights, model.trees, strict=True)]
    detector = Detector(roots, {})
    score = detector.score(F.struct(*[F.col(n) for n in FEATURES]))
    scored = table.filter(aside & (F.col("label") == 1)).groupBy("kind")
    for row in scored.agg(F.count("*").alias("n"), F.avg(score).alias("mean")).collect():  # one row per kind
        if row["n"] >= MIN_LABELLED:
            detector.thresholds[row["kind"]] = min_share * row["mean"]
    return detector


def ordered(spans: Column) -> Column:
    """The spans by start, then kind as listed, without the matched text."""
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_personal_data(docs: DataFrame, detector: Detector | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base (spans of the base rules), spans (those and the added ones).

    A span is (kind, start, end) in code points, end exclusive. Null and empty texts have none;
    equal starts are ordered by kind as listed in KINDS; texts are scanned whole; repeated rows
    and null ids stay rows; other columns are not read. Without a detector there are only
    base spans.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = computed_once(rows, {"base": base_spans(F.col("text"))})
    if detector is None or not detector.thresholds:
        return rows.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.col("base")).alias("spans"))
    rows = computed_once(rows, {"found": candidates(F.col("text"))})
    rows = computed_once(rows, {"free": untouched(F.col("found"), F.col("base"))})
    described = F.transform(
        "free",
        lambda s: F.struct(s.alias("span"), F.struct(*[c.alias(n) for n, c in feature_columns(s).items()]).alias("features")),
    )
    rows = computed_once(rows, {"described": described})

    def accepted(candidate: Column) -> Column:
        least = F.lit(2.0)
        for kind, threshold in detector.thresholds.items():
            least = F.when(candidate["span"]["kind"] == kind, threshold).otherwise(least)
        return detector.score(candidate["features"]) >= least

    added = F.transform(F.filter("described", accepted), lambda c: c["span"])
    return rows.select("doc_id", ordered(F.col("base")).alias("base"), ordered(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans as a string."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in BASE_KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
