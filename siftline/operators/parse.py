"""Log lines to events, features and labels. One projection, no shuffle; streams too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.numeric import reading
from siftline.functions.once import computed_once
from siftline.functions.text import pick, strip_text, words

EVENT_FIELDS = ("date", "time", "level", "service", "message", "cpu", "memory", "action")
TOO_FEW_TOKENS = "too few tokens"


def clean_lines(lines: DataFrame, col: str = "raw_log") -> DataFrame:
    """Strip every line and drop the blank ones."""
    return lines.withColumn(col, strip_text(F.col(col))).filter(F.col(col) != "")


def parse_logs(lines: DataFrame, col: str = "raw_log") -> DataFrame:
    """Add the eight event fields and `parse_error`.

    Tokens 0-3 are date, time, level and service. The message runs from token 4 to the
    first of the words cpu, memory and action anywhere in the line; each of these is
    followed by its value.
    """
    tokens = F.col("_tokens")
    complete = F.col("_complete")

    def at(index: Column | int) -> Column:
        index = F.lit(index) if isinstance(index, int) else index
        return F.when(complete, F.get(tokens, index))

    marks = {key: F.array_position(tokens, key).cast("int") for key in ("cpu", "memory", "action")}
    ends = [F.when(mark > 0, mark - 1) for mark in marks.values()]
    stop = F.coalesce(F.least(*ends), F.size(tokens))
    message = F.array_join(F.slice(tokens, F.lit(5), F.greatest(stop - 4, F.lit(0))), " ")

    # The position of a mark counts from one, so it is also the index of the word after it.
    value_of = {key: at(F.when(mark > 0, mark)) for key, mark in marks.items()}

    return (
        computed_once(lines, {"_tokens": words(F.col(col))})
        .withColumn("_complete", F.size("_tokens") >= 4)
        .withColumns(
            {
                "date": at(0),
                "time": at(1),
                "level": F.upper(at(2)),
                "service": F.lower(at(3)),
                "message": F.when(complete, F.lower(message)),
                "cpu": value_of["cpu"],
                "memory": value_of["memory"],
                "action": value_of["action"],
                "parse_error": F.when(~complete, F.lit(TOO_FEW_TOKENS)),
            }
        )
        .drop("_tokens", "_complete")
    )


def numeric_readings(events: DataFrame) -> DataFrame:
    """Replace absent, non-integer and out-of-range readings by -1 and flag them."""
    columns = {}
    for name in ("cpu", "memory"):
        columns[name], columns[f"{name}_missing"] = reading(F.col(name))
    return events.withColumns(columns)


def indicator_columns() -> dict[str, Column]:
    """0/1 columns for known services and levels and for the two message words."""
    hits = {f"service_is_{s}": F.col("service") == s for s in cfg.KNOWN_SERVICES}
    hits |= {f"level_is_{v}": F.col("level") == v for v in cfg.KNOWN_LEVELS}
    hits |= {f"has_{w}": F.col("message").contains(w) for w in ("timeout", "latency")}
    return {name: hit.cast("int") for name, hit in hits.items()}


def extract_features(events: DataFrame) -> DataFrame:
    """Add the twelve numeric features; cpu and memory become numbers."""
    return numeric_readings(events).withColumns(indicator_columns())


def feature_map(features: DataFrame, col: str = "features") -> DataFrame:
    """Name-to-value map of the features."""
    pairs = []
    for name in cfg.FEATURE_NAMES:
        pairs += [F.lit(name), F.col(name)]
    return features.withColumn(col, F.create_map(*pairs))


def encode_labels(events: DataFrame) -> DataFrame:
    """Add `label` (index of the action) and `label_error`."""
    action = F.col("action")
    label = pick("action", {name: k for k, name in enumerate(cfg.KNOWN_ACTIONS)})
    problem = (
        F.when(F.col("parse_error").isNotNull(), None)
        .when(action.isNull(), F.lit("missing label: action"))
        .when(label.isNull(), F.concat(F.lit("unknown action: '"), action, F.lit("'")))
    )
    return events.withColumns({"label": label, "label_error": problem})


def training_rows(lines: DataFrame) -> DataFrame:
    """Parsed, featured and labelled rows with one `error` column; null error means usable."""
    rows = extract_features(encode_labels(parse_logs(lines)))
    return rows.withColumn("error", F.coalesce("parse_error", "label_error"))


def usable_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error", "parse_error", "label_error")


def rejected_rows(rows: DataFrame, line: str = "raw_log") -> DataFrame:
    return rows.filter(F.col("error").isNotNull()).withColumnRenamed(line, "line")


def display_action(action: str = "action") -> Column:
    """Model action (column name) to the action shown to users."""
    return pick(action, cfg.DISPLAY_ACTION)


def with_action_dimensions(rows: DataFrame, action: str, policy: cfg.DecisionPolicy) -> DataFrame:
    """Add the risk level and the approval flag of an action."""
    return rows.withColumns(
        {
            "risk_level": pick(action, policy.action_risk),
            "requires_approval": pick(action, policy.needs_approval),
        }
    )
