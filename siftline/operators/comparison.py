"""Comparison groups: fair run set, contract, best runs and what to do next.

A group may hold most of the runs, so no window or join runs over the runs of a group.
Runs are first reduced to cells (group, which controlled tags are present), at most
2**6 rows per group; everything about a group is merged from its cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline import config as cfg
from siftline.functions.once import computed_once
from siftline.functions.text import pick
from siftline.operators import lookup

GROUP = "comparison_group_id"
LAST = 9_223_372_036_854_775_807
CHECK_NAMES = (
    "single_comparison_group_id",
    "single_comparison_type",
    "single_changed_variable",
    "controlled_variables_passed",
    "at_least_two_runs",
)
_NEWEST_FIRST = (
    f"struct(coalesce(-unix_micros(try_cast(start_time AS TIMESTAMP)), {LAST}) AS age, run_id AS run_id)"
)
_PINNED = tuple(cfg.CONTROLLED_VARIABLE_TAG.values())
_SHARED = ("comparison_type", "changed_variable")


def usable_groups(runs: DataFrame) -> DataFrame:
    """Runs that belong to a named comparison group."""
    return runs.filter(~F.coalesce(F.col(GROUP), F.lit("")).isin("", "unknown", "missing", "null"))


def tag(name: str) -> Column:
    return F.expr(_tag(name))


def _tag(name: str) -> str:
    return f"coalesce({name}, 'unknown')"


def newest_first() -> Column:
    """Ascending key of "latest start, then run id": the order in which a run store lists."""
    return F.expr(_NEWEST_FIRST)


def variables(text: Column) -> Column:
    """Names in a comma-separated list."""
    return F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: v != "")


def _presence() -> Column:
    """Bit set of the pinned tags a run carries."""
    unknown = "('', 'unknown', 'missing')"
    bits = [f"if({_tag(t)} NOT IN {unknown}, {1 << k}, 0)" for k, t in enumerate(_PINNED)]
    return F.expr(" + ".join(bits))


def _required(names: str) -> Column:
    """Bit set of the tags that a list of controlled variables asks for."""
    bits = [
        f"if(array_contains({names}, '{v}'), {1 << k}, 0)"
        for k, v in enumerate(cfg.CONTROLLED_VARIABLE_TAG)
    ]
    return F.expr(" + ".join(bits))


def _has_all(required: Column, present: Column) -> Column:
    return required.bitwiseAND(present) == required


def _best(metric: str, sign: int) -> Column:
    value = f"try_cast({metric} AS DOUBLE)"
    fields = f"{-sign} * {value} AS key, {_NEWEST_FIRST} AS order, run_id AS run_id, "
    fields += f"{_tag('variant_name')} AS variant_name, {value} AS value"
    if metric == "f1_macro":
        fields += ", combined_weakest_class_recall AS recall, low_confidence_rate AS low_confidence"
    return F.expr(f"min(CASE WHEN {value} IS NOT NULL AND NOT isnan({value}) THEN struct({fields}) END)")


def comparison_cells(runs: DataFrame) -> DataFrame:
    """Kept cells of every group with mergeable statistics, after the completeness rule.

    The controlled variables of a group are those of its first run. Runs lacking a required
    tag are dropped, unless fewer than two complete runs would remain.
    """
    head = F.struct(
        newest_first().alias("order"),
        F.coalesce("controlled_variables", F.lit("")).alias("controlled"),
    )
    statistics = {"n": F.count("*"), "head": F.min(head)}
    for name in (*_PINNED, *_SHARED):
        statistics[f"min_{name}"] = F.expr(f"min({_tag(name)})")
        statistics[f"max_{name}"] = F.expr(f"max({_tag(name)})")
    for title, metric, sign in cfg.BEST_RUN_METRICS:
        statistics[title] = _best(metric, sign)
    f1 = F.col("f1_macro").try_cast("double")
    statistics |= {"f1_low": F.min(f1), "f1_high": F.max(f1), "f1_n": F.count(f1)}

    cells = (
        usable_groups(runs)
        .groupBy(GROUP, _presence().alias("present"))
        .agg(*[c.alias(name) for name, c in statistics.items()])
    )
    # Windows over the cells of a group: at most 64 rows each.
    group = W.partitionBy(GROUP)
    return (
        cells.withColumn("raw_run_count", F.sum("n").over(group))
        .withColumn("_asked", variables(F.min("head").over(group)["controlled"]))
        .withColumn("required", _required("_asked"))
        .drop("_asked")
        .withColumn("complete", _has_all(F.col("required"), F.col("present")))
        .withColumn("complete_n", F.sum(F.when(F.col("complete"), F.col("n")).otherwise(0)).over(group))
        .filter(F.col("complete") | (F.col("complete_n") < 2))
    )


def group_scope(cells: DataFrame) -> DataFrame:
    """Per group: required tags, whether incomplete runs stay, number of raw runs."""
    return cells.groupBy(GROUP).agg(
        F.first("required").alias("required"),
        (F.first("complete_n") < 2).alias("keep_all"),
        F.first("raw_run_count").alias("raw_run_count"),
    )


def complete_runs(runs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The runs each group is compared on."""
    cells = comparison_cells(runs) if cells is None else cells
    rows = lookup.attach(
        usable_groups(runs), group_scope(cells), GROUP, "raw_run_count", spread="run_id", how="inner"
    )
    keep = F.col("keep_all") | _has_all(F.col("required"), _presence())
    return rows.filter(keep).drop("required", "keep_all")


def _variable_checks() -> Column:
    """One struct per controlled variable of a merged group row."""

    arms = cfg.CONTROLLED_VARIABLE_TAG.items()
    pinned = " ".join(f"WHEN '{v}' THEN '{t}'" for v, t in arms)
    low, high = (" ".join(f"WHEN '{v}' THEN {side}_{t}" for v, t in arms) for side in ("min", "max"))
    return F.expr(
        f"""transform(
          transform(controlled, v -> struct(v AS name, CASE v {pinned} END AS tag,
            CASE v {low} END AS low, CASE v {high} END AS high)),
          c -> struct(c.name AS controlled_variable, coalesce(c.tag, '') AS tag,
            CASE WHEN c.tag IS NULL THEN 'not_checked'
              WHEN c.low = c.high AND c.low NOT IN ('missing', 'unknown') THEN 'passed'
              ELSE 'failed' END AS status,
            CASE WHEN c.low = c.high THEN c.low WHEN c.tag IS NOT NULL THEN 'mixed' END AS value))"""
    )


def pick_column(name: Column, options: dict[str, Column]) -> Column:
    out = None
    for key, value in options.items():
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out


def _single(name: str) -> Column:
    return F.col(f"min_{name}") == F.col(f"max_{name}")


def summarize_groups(cells: DataFrame) -> DataFrame:
    """One row per group: validation, contract, best runs, spread, advice."""
    merged = {
        "run_count": F.sum("n"),
        "raw_run_count": F.first("raw_run_count"),
        "head": F.min("head"),
        "f1_low": F.min("f1_low"),
        "f1_high": F.max("f1_high"),
        "f1_n": F.sum("f1_n"),
    }
    for name in (*_PINNED, *_SHARED):
        merged[f"min_{name}"] = F.expr(f"min(min_{name})")
        merged[f"max_{name}"] = F.expr(f"max(max_{name})")
    for title, _, _ in cfg.BEST_RUN_METRICS:
        merged[title] = F.min(title)
    rows = (
        cells.groupBy(GROUP)
        .agg(*[c.alias(name) for name, c in merged.items()])
        .withColumn("controlled", variables(F.col("head.controlled")))
    )
    rows = computed_once(rows, {"variable_checks": _variable_checks()})
    passed = (F.size("variable_checks") > 0) & F.forall(
        "variable_checks", lambda c: c.status == "passed"
    )
    checks = {
        "single_comparison_group_id": F.lit(True),
        "single_comparison_type": _single("comparison_type"),
        "single_changed_variable": _single("changed_variable"),
        "controlled_variables_passed": passed,
        "at_least_two_runs": F.col("run_count") >= 2,
    }
    valid = reduce(lambda a, b: a & b, [F.col(c) for c in CHECK_NAMES])
    spread = F.when(F.col("f1_n") >= 2, F.col("f1_high") - F.col("f1_low"))
    states = {
        "controlled_variable_status": F.when(
            F.col("controlled_variables_passed"), "passed"
        ).otherwise("failed"),
        "comparison_status": F.when(valid, "valid").otherwise("invalid"),
        **{
            name: F.when(_single(name), F.col(f"min_{name}")).otherwise(F.lit("mixed"))
            for name in _SHARED
        },
        "f1_macro_spread": spread,
    }
    return (
        computed_once(rows.withColumns(checks), states)
        .withColumn("blocked_reason", _blocked_reason())
        .drop("head", "f1_low", "f1_high", "f1_n", *[c for c in rows.columns if c[:4] in ("min_", "max_")])
    )


def controlled_variable_checks(groups: DataFrame) -> DataFrame:
    """Long rows: group, variable, tag, status, value ('mixed' when there are several)."""
    return groups.select(GROUP, F.inline("variable_checks"))


def tag_values(runs: DataFrame, name: str) -> DataFrame:
    """Distinct values of one tag per group, one row each."""
    return runs.select(GROUP, tag(name).alias("value")).distinct()


def candidate_pool(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Runs of the groups with a valid contract."""
    valid = groups.filter("comparison_status = 'valid'").select(
        GROUP, "raw_run_count", F.lit(True).alias("ready_for_candidate_selection")
    )
    return lookup.attach(kept, valid, GROUP, "raw_run_count", spread="run_id", how="inner")


def best_runs(groups: DataFrame) -> DataFrame:
    """Long rows: group, title, metric, run, variant and the metric's own value."""
    rows = F.array(
        *[
            F.struct(
                F.lit(title).alias("title"),
                F.lit(metric).alias("metric_name"),
                F.col(f"{title}.run_id").alias("run_id"),
                F.col(f"{title}.variant_name").alias("variant_name"),
                F.col(f"{title}.value").alias("metric_value"),
            )
            for title, metric, _ in cfg.BEST_RUN_METRICS
        ]
    )
    return groups.select(GROUP, F.inline(rows)).filter(F.col("run_id").isNotNull())


# Texts of the trade-off summary.
_SAME_LATENCY = "The same variant currently wins both f1_macro and p95 offline latency."
_OTHER_LATENCY = (
    "There is a quality/latency tradeoff: the best f1_macro variant is not the fastest p95 "
    "offline latency variant."
)
_SAME_CONFIDENCE = "The same variant currently wins both f1_macro and low_confidence_rate."
_OTHER_CONFIDENCE = (
    "There is a quality/confidence tradeoff: the best f1_macro variant is not the variant with "
    "the lowest low_confidence_rate."
)
_NO_TRADEOFF = "No clear tradeoff could be inferred from the available metrics."


def with_tradeoffs(groups: DataFrame) -> DataFrame:
    """Add `tradeoff_summary`, an array of one or two sentences."""

    def sentence(other: str, same: str, differs: str) -> Column:
        f1_run, other_run = F.col("best_f1_macro.run_id"), F.col(f"{other}.run_id")
        return F.when(f1_run == other_run, F.lit(same)).when(f1_run != other_run, F.lit(differs))

    found = F.array_compact(
        F.array(
            sentence("best_latency_p95", _SAME_LATENCY, _OTHER_LATENCY),
            sentence("best_low_confidence_rate", _SAME_CONFIDENCE, _OTHER_CONFIDENCE),
        )
    )
    return groups.withColumn(
        "tradeoff_summary", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(_NO_TRADEOFF)))
    )


def _blocked_reason() -> Column:
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in CHECK_NAMES]))
    variables_failed = F.array_sort(
        F.array_distinct(
            F.transform(
                F.filter("variable_checks", lambda c: c.status == "failed"),
                lambda c: c.controlled_variable,
            )
        )
    )

    def part(text: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(names, ", ")))

    reasons = F.concat_ws(
        "; ",
        part("failed contract checks: ", failed),
        part("failed controlled variables: ", variables_failed),
    )
    return F.when(F.col("comparison_status") != "valid", reasons)


# Type, next experiment and reason of each rung of the advice ladder.
ADVICE = {
    "rerun_invalid_comparison": ("rerun_same_experiment_after_fixing_contract", None),
    "data_or_feature_pipeline_experiment": (
        "weakest_class_data_or_feature_pipeline",
        "The best f1 variant still has weak recall on at least one class, so another "
        "model-family comparison is unlikely to be the highest-leverage next step.",
    ),
    "confidence_or_feature_experiment": (
        "confidence_threshold_or_feature_pipeline",
        "The best f1 variant still produces too many low-confidence decisions. The next "
        "experiment should target confidence, features, or threshold behavior.",
    ),
    "change_experiment_direction": (
        "feature_pipeline_experiment",
        "The compared variants are too close on f1_macro. Continuing to test similar variants "
        "is unlikely to produce a meaningful quality gain.",
    ),
    "quality_latency_tradeoff_experiment": (
        "latency_or_cost_tradeoff_experiment",
        "The best quality variant is not the fastest variant. The next experiment should "
        "clarify whether the quality gain is worth the latency/cost tradeoff.",
    ),
    "candidate_selection": (
        "candidate_selection_policy",
        "The comparison is valid and no blocking quality/confidence issue was detected. The "
        "next step is candidate selection, not another experiment.",
    ),
    "insufficient_metrics": ("rerun_with_required_metrics", "No usable metric winner was found."),
    "no_experiments_found": (
        "run_first_config_driven_comparison",
        "No MLflow comparison groups were found.",
    ),
}


def number_text(col: Column) -> Column:
    """Shortest text of a number that was rounded to four digits."""
    plain = F.round(col, 4).cast("decimal(38,4)").cast("string")
    return F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")


def with_advice(groups: DataFrame, limits: cfg.HistoryThresholds) -> DataFrame:
    """Add the first matching rung: type, next experiment, reason and evidence text."""
    best, fastest = F.col("best_f1_macro"), F.col("best_latency_p95")
    have_best = best.isNotNull()
    ladder = [
        ("rerun_invalid_comparison", F.col("comparison_status") != "valid"),
        ("data_or_feature_pipeline_experiment", best["recall"] < limits.weakest_recall),
        ("confidence_or_feature_experiment", best["low_confidence"] > limits.low_confidence_rate),
        ("change_experiment_direction", F.col("f1_macro_spread") < limits.f1_delta),
        ("quality_latency_tradeoff_experiment", best["run_id"] != fastest["run_id"]),
        ("candidate_selection", have_best),
    ]
    kind = None
    for name, test in ladder:
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
    kind = kind.otherwise(F.lit("insufficient_metrics"))

    def said(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}="), value)

    evidence = {
        "rerun_invalid_comparison": [
            said("comparison_status", F.col("comparison_status")),
            said("controlled_variable_status", F.col("controlled_variable_status")),
        ],
        "data_or_feature_pipeline_experiment": [
            said("best_variant", best["variant_name"]),
            said("combined_weakest_class_recall", number_text(best["recall"])),
        ],
        "confidence_or_feature_experiment": [
            said("best_variant", best["variant_name"]),
            said("low_confidence_rate", number_text(best["low_confidence"])),
        ],
        "change_experiment_direction": [
            said("f1_macro_spread", number_text(F.col("f1_macro_spread"))),
            F.lit(f"meaningful_delta_threshold={limits.f1_delta}"),
        ],
        "quality_latency_tradeoff_experiment": [
            said("best_f1_variant", best["variant_name"]),
            said("best_latency_variant", fastest["variant_name"]),
        ],
        "candidate_selection": [
            said("best_f1_variant", best["variant_name"]),
            said("comparison_type", F.col("comparison_type")),
            said("changed_variable", F.col("changed_variable")),
        ],
        "insufficient_metrics": [F.lit("missing best_f1_macro")],
    }
    name = F.col("recommendation_type")
    kind_name = "recommendation_type"
    texts = {k: reason for k, (_, reason) in ADVICE.items() if reason is not None}
    return groups.withColumn("recommendation_type", kind).withColumns(
        {
            "recommended_next_experiment": pick(kind_name, {k: v for k, (v, _) in ADVICE.items()}),
            "recommendation_reason": F.coalesce(pick(kind_name, texts), F.col("blocked_reason")),
            "evidence": pick_column(name, {k: F.array(*v) for k, v in evidence.items()}),
        }
    )


def overall_next_step(groups: DataFrame) -> DataFrame:
    """One row: advice of the first invalid group, else of the first one that is not ready
    for selection, else of the first ready one; a constant when there is no group."""
    priority = (
        F.when(F.col("comparison_status") != "valid", 0)
        .when(F.col("recommendation_type") != "candidate_selection", 1)
        .otherwise(2)
    )
    fields = F.struct(
        "recommendation_type",
        "recommended_next_experiment",
        F.col("recommendation_reason").alias("reason"),
        F.col(GROUP).alias("source_group_id"),
    )
    first = groups.agg(F.min_by(fields, F.struct(priority, F.col(GROUP))).alias("step"))
    step, reason = ADVICE["no_experiments_found"]
    nothing = F.struct(
        F.lit("no_experiments_found").alias("recommendation_type"),
        F.lit(step).alias("recommended_next_experiment"),
        F.lit(reason).alias("reason"),
        F.lit(None).cast("string").alias("source_group_id"),
    )
    return first.select(F.coalesce("step", nothing).alias("step")).select("step.*")


def history_totals(groups: DataFrame) -> DataFrame:
    """Counts of groups by contract status."""
    valid = F.count_if(F.col("comparison_status") == "valid")
    return groups.agg(
        F.count("*").alias("total_comparison_groups"),
        valid.alias("valid_comparison_groups"),
        F.count_if(F.col("comparison_status") != "valid").alias("invalid_comparison_groups"),
        valid.alias("ready_for_candidate_selection_groups"),
    )


def metric_table(values: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """run_id by metric from long values; the metric list is fixed, so no extra job runs.

    One aggregation by run: a pivot first groups by run and key, which holds a row for every metric.
    """
    rows = values.filter((F.col("kind") == "metrics") & F.col("key").isin(*metrics))
    number = F.when(~F.col("value").isin("NaN", "nan"), F.col("value").try_cast("double"))
    return rows.groupBy("run_id").agg(*[F.max(F.when(F.col("key") == name, number)).alias(name) for name in metrics])


def config_drift(runs: DataFrame, expected: cfg.TrainingSettings) -> DataFrame:
    """Add `drift`: settings of a run that differ from the expected training configuration
    although they are not what the comparison changes."""
    changed = tag("changed_variable")
    text_experiments = (
        "feature_pipeline",
        "vectorizer",
        "vectorizer_name",
        "vectorizer_params",
        "tfidf_max_features",
        "tfidf_ngram_range",
    )
    uses_tfidf = (F.col("vectorizer_name") == "TfidfVectorizer") & ~changed.isin(*text_experiments)

    def differs(name: str, want: str | None, applies: Column) -> Column:
        return F.when(applies & ~F.col(name).eqNullSafe(F.lit(want)), F.lit(name))

    found = F.array(
        differs("max_features", expected.max_features, uses_tfidf),
        differs("ngram_range", expected.ngram_range, uses_tfidf),
        differs("random_state", str(expected.seed), ~changed.isin("random_state", "seed")),
        differs("model_max_iter", str(expected.max_iter), ~changed.isin("model_max_iter", "max_iter")),
    )
    return runs.withColumn("drift", F.array_compact(found))
