"""Classification, decision-quality and latency evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.functions.durable import durable
from siftline.functions.numeric import ratio
from siftline.functions.once import computed_once
from siftline.operators import lookup

def confusion_matrix(
    pairs: DataFrame, labels: tuple[str, ...], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """label_id/label by predicted_id/predicted with counts, zeros included.

    One aggregate with a conditional count per cell, so the rows combine map-side and no
    grid has to be joined. actual and predicted are label indexes.
    """
    ids = range(len(labels))
    cells = pairs.agg(
        *[
            F.count_if((F.col(actual) == i) & (F.col(predicted) == j)).alias(f"c_{i}_{j}")
            for i in ids
            for j in ids
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("actual_id"),
                F.lit(labels[i]).alias("actual"),
                F.lit(j).alias("predicted_id"),
                F.lit(labels[j]).alias("predicted"),
                F.col(f"c_{i}_{j}").alias("n"),
            )
            for i in ids
            for j in ids
        ]
    )
    return cells.select(F.inline(rows))


def class_counts(matrix: DataFrame) -> DataFrame:
    """Per label: true positives, predicted total and support."""
    cell = F.struct("label_id", "label")
    sides = matrix.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("actual_id").alias("label_id"),
                    F.col("actual").alias("label"),
                    F.when(F.col("actual_id") == F.col("predicted_id"), F.col("n"))
                    .otherwise(F.lit(0))
                    .alias("hit"),
                    F.col("n").alias("as_actual"),
                    F.lit(0).cast("bigint").alias("as_predicted"),
                ),
                F.struct(
                    F.col("predicted_id").alias("label_id"),
                    F.col("predicted").alias("label"),
                    F.lit(0).cast("bigint").alias("hit"),
                    F.lit(0).cast("bigint").alias("as_actual"),
                    F.col("n").alias("as_predicted"),
                ),
            )
        )
    )
    return (
        sides.groupBy(cell.alias("cell"))
        .agg(
            F.sum("hit").alias("hits"),
            F.sum("as_predicted").alias("predicted_n"),
            F.sum("as_actual").alias("support"),
        )
        .select("cell.label_id", "cell.label", "hits", "predicted_n", "support")
    )


def _raw_rates() -> dict[str, Column]:
    hits, predicted, support = F.col("hits"), F.col("predicted_n"), F.col("support")
    zero = F.lit(0.0)
    return {
        "precision": F.coalesce(F.try_divide(hits, predicted), zero),
        "recall": F.coalesce(F.try_divide(hits, support), zero),
        "f1": F.coalesce(F.try_divide(2.0 * hits, predicted + support), zero),
    }


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 rounded to four digits, and support, per label."""
    counts = class_counts(matrix)
    rates = {name: F.round(value, 4) for name, value in _raw_rates().items()}
    return counts.withColumns(rates).select(
        "label_id", "label", "precision", "recall", "f1", "support"
    )


def weakest_class(metrics: DataFrame) -> DataFrame:
    """Label with the lowest rounded recall, the first in label order on a tie."""
    order = F.struct("recall", "label_id")
    return metrics.agg(
        F.min_by("label", order).alias("weakest_class_by_recall"),
        F.min("recall").alias("weakest_class_recall"),
    )


def accuracy(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    return pairs.agg(
        F.coalesce(F.round(F.avg(hit), 6), F.lit(0.0)).alias("accuracy"),
        F.count("*").alias("row_count"),
    )


def macro_f1(matrix: DataFrame) -> DataFrame:
    """Mean of the unrounded F1 over the labels that occur as actual or predicted."""
    present = class_counts(matrix).filter("support > 0 OR predicted_n > 0")
    return present.withColumn("f1", _raw_rates()["f1"]).agg(
        F.coalesce(F.round(F.avg("f1"), 6), F.lit(0.0)).alias("f1_macro"),
        F.count("*").alias("present_labels"),
    )


def mistakes(rows: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return rows.filter(F.col(actual) != F.col(predicted))


def safe_label(col: Column) -> Column:
    """Label as part of a metric name."""
    return F.translate(F.lower(F.trim(col)), " -/", "___")


def flat_metrics(metrics: DataFrame, prefix: str) -> DataFrame:
    """metric/value rows named prefix_label_metric, plus the weakest recall."""
    name = F.concat(F.lit(f"{prefix}_"), safe_label(F.col("label")), F.lit("_"))
    rows = F.array(
        *[
            F.struct(
                F.concat(name, F.lit(m)).alias("metric"), F.col(m).cast("double").alias("value")
            )
            for m in ("precision", "recall", "f1", "support")
        ]
    )
    weakest = metrics.agg(
        F.lit(f"{prefix}_weakest_class_recall").alias("metric"), F.min("recall").alias("value")
    )
    return metrics.select(F.inline(rows)).unionByName(weakest)


def decision_quality(
    decisions: DataFrame, min_confidence: float, by: tuple[str, ...] = ()
) -> DataFrame:
    """Counts and rates of low confidence, approval, blocking, fallback and bad schema.

    Needs confidence, requires_approval, policy_allowed and strategy_used; `contract_ok`
    is used when present. A group-free call on no rows gives one row of zeros.
    """
    total = F.count("*")
    low = F.count_if(F.col("confidence") < min_confidence)
    approval = F.count_if("requires_approval")
    invalid = (
        F.count_if(~F.col("contract_ok"))
        if "contract_ok" in decisions.columns
        else F.lit(0).cast("bigint")
    )
    return decisions.groupBy(*by).agg(
        total.alias("decision_count"),
        low.alias("low_confidence_count"),
        ratio(low, total).alias("low_confidence_rate"),
        approval.alias("approval_required_count"),
        ratio(approval, total).alias("approval_required_rate"),
        F.count_if(~F.col("policy_allowed")).alias("policy_block_count"),
        F.count_if(F.col("strategy_used") == "llm_fallback").alias("llm_fallback_count"),
        invalid.alias("invalid_decision_schema_count"),
    )


def decisions_below(decisions: DataFrame, min_confidence: float) -> DataFrame:
    return decisions.filter(F.col("confidence") < min_confidence)


def decisions_needing_approval(decisions: DataFrame) -> DataFrame:
    return decisions.filter("requires_approval")


def decisions_blocked(decisions: DataFrame) -> DataFrame:
    return decisions.filter(~F.col("policy_allowed"))


def by_confidence(decisions: DataFrame, tie: str) -> DataFrame:
    """All decisions, least confident first (a range-partitioned sort)."""
    return decisions.orderBy("confidence", tie)


def slowest_first(samples: DataFrame, latency: str, tie: str) -> DataFrame:
    """All samples, slowest first; add .limit(n) for a top-n."""
    return samples.orderBy(F.desc(latency), tie)


def ordered_bits(value: Column) -> Column:
    """A long that orders as the double does: its 64-bit pattern, turned over for negative numbers.

    Sign, exponent and fraction are taken apart by exact powers of two. Both zeros are one
    number; infinities lie outside all numbers and NaN lies above.
    """
    least = 2.0**-1022
    whole = F.abs(value)
    size = F.when((whole >= least) & (whole < float("inf")), whole).otherwise(1.0)
    rough = F.floor(F.log2(size))
    # The logarithm may be rounded across a power of two, either way.
    power = rough - F.when(F.pow(F.lit(2.0), rough) > size, 1).otherwise(0)
    power = power + F.when(size >= F.pow(F.lit(2.0), power + 1), 1).otherwise(0)
    scaled = size / F.pow(F.lit(2.0), power) * float(1 << 52)
    normal = (power + 1022) * F.lit(1 << 52) + scaled.cast("long")
    infinite = F.lit(2047 << 52).cast("long")
    # Subnormal numbers are their own pattern, in units of the smallest one, 2**-1074.
    below = F.when(whole < least, whole).otherwise(0.0)
    tiny = (below / F.lit(least) * float(1 << 52)).cast("long")
    pattern = F.when(whole < least, tiny).when(whole < float("inf"), normal).otherwise(infinite)
    return F.when(F.isnan(value), infinite + 1).when(value < 0, -pattern).otherwise(pattern)


_DIGIT_BITS = 16
# Targets that a pass sends to every task; more of them take the join that splits heavy keys.
_BROADCAST_TARGETS = 100_000


def nearest_rank_percentiles(
    samples: DataFrame,
    value: str,
    quantiles: dict[str, float],
    by: tuple[str, ...] = (),
    broadcast_targets: int = _BROADCAST_TARGETS,
) -> DataFrame:
    """Exact nearest-rank percentiles per group as long rows (group, quantile, value).

    Radix selection for all groups and quantiles at once: a pass counts rows by the next 16 bits
    of the ordered pattern, inside the cells that the wanted ranks were found in so far, and
    steps into one cell for each rank. At most four passes read the samples, fewer if all
    cells hold one value. A group has at most 65,536 counters in a pass however many rows and values it
    has, and no value is sorted. Null values are no samples; the passes run when this is called.
    """
    keys = list(by)
    group = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    number = F.col(value).cast("double")
    rows = samples.filter(number.isNotNull()).select(*keys, group.alias("_g"), number.alias("_v"))
    rows = computed_once(rows, {"_bits": ordered_bits(F.col("_v"))})
    wanted = F.array(*[F.struct(F.lit(n).alias("quantile"), F.lit(float(q)).alias("_q")) for n, q in quantiles.items()])
    found = None
    for shift in range(64 - _DIGIT_BITS, -1, -_DIGIT_BITS):
        digit = F.shiftright("_bits", shift)
        if found is None:
            inside, cell = rows, ["_g"]
        else:
            # One row per cell that a rank lies in; its path holds all bits above the digit.
            paths = found.groupBy("_g", "_path").agg(F.max("_n").alias("_n"))
            at = F.concat_ws("|", "_g", F.shiftright("_bits", shift + _DIGIT_BITS).cast("string"))
            dim = paths.select(F.concat_ws("|", "_g", F.col("_path").cast("string")).alias("_at"), "_path", "_n")
            placed = rows.withColumn("_at", at)
            if found.count() <= broadcast_targets:
                inside = placed.join(F.broadcast(dim.drop("_n")), "_at")
            else:
                inside = lookup.attach(placed, dim, "_at", "_n", spread="_bits", how="inner")
            cell = ["_g", "_path"]
        firsts = [F.first(k).alias(k) for k in keys]
        counted = inside.groupBy(*cell, digit.alias("_digit")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_low"), F.min("_bits").alias("_least"), F.max("_bits").alias("_most"), *firsts
        )
        upto = F.sum("_n").over(W.partitionBy(*cell).orderBy("_digit"))
        counted = counted.withColumn("_upto", upto)
        if found is None:
            counted = counted.withColumn("_total", F.sum("_n").over(W.partitionBy("_g")))
            ranked = counted.select("*", F.inline(wanted))
            ranked = ranked.withColumn("_rank", F.greatest(F.ceil(F.col("_q") * F.col("_total")), F.lit(1)).cast("long"))
        else:
            left = found.select("_g", "_path", "quantile", "_rank")
            if found.count() <= broadcast_targets:
                left = F.broadcast(left)
            ranked = counted.join(left, cell)
        hit = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))
        stepped = ranked.filter(hit).select(
            *keys, "_g", F.col("_digit").alias("_path"), "quantile", "_n", "_low",
            (F.col("_least") == F.col("_most")).alias("_single"), (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"),
        )
        found = durable(stepped)
        if not found.filter("NOT _single").limit(1).count():
            break
    return found.select(*keys, "quantile", F.col("_low").alias("value"))


def latency_summary(
    samples: DataFrame, value: str, by: tuple[str, ...], digits: int = 4
) -> DataFrame:
    """Sample count, p50, p95 and maximum per group; zeros where a group has no sample."""
    if not by:
        # One overall group under a constant key; an empty input still gives its row.
        overall = samples.select(F.lit(0).alias("_all"), value)
        zero = samples.sparkSession.range(1).select(F.lit(0).alias("_all"))
        found = latency_summary(overall, value, ("_all",), digits)
        return zero.join(found, "_all", "left").drop("_all").fillna(0)
    keys = list(by)
    totals = samples.groupBy(*keys).agg(
        F.count(value).alias("sample_count"),
        F.coalesce(F.round(F.max(F.col(value).cast("double")), digits), F.lit(0.0)).alias("max_ms"),
    )
    ranks = (
        nearest_rank_percentiles(samples, value, {"p50_ms": 0.50, "p95_ms": 0.95}, by)
        .groupBy(*keys)
        .pivot("quantile", ["p50_ms", "p95_ms"])
        .agg(F.first("value"))
    )
    # A null group is a group like any other.
    own = ranks.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    joined = totals.join(own, same, "left")
    return joined.select(
        *keys,
        "sample_count",
        *[
            F.coalesce(F.round(p, digits), F.lit(0.0)).alias(p)
            for p in ("p50_ms", "p95_ms")
        ],
        "max_ms",
    )

