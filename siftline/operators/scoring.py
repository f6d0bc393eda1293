"""Scoring with a given coefficient table: plain arithmetic inside one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import config as cfg
from siftline.functions.numeric import softmax_top
from siftline.functions.once import computed_once
from siftline.functions.text import sql_literal


@dataclass(frozen=True)
class LinearModel:
    """Intercept and one weight per feature, for each class in label order."""

    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    features: tuple[str, ...] = cfg.FEATURE_NAMES

    def margins(self) -> list[Column]:
        """Linear margin of each class."""
        out = []
        for intercept, row in zip(self.intercepts, self.weights, strict=True):
            terms = [sql_literal(float(intercept))]
            for name, weight in zip(self.features, row, strict=True):
                if weight:
                    terms.append(f"({sql_literal(float(weight))}) * {name}")
            out.append(F.expr(" + ".join(terms)))
        return out


def score(features: DataFrame, model: LinearModel) -> DataFrame:
    """Add `predicted_label` and its softmax `probability`."""
    margins = {f"_margin_{k}": margin for k, margin in enumerate(model.margins())}
    label, probability = softmax_top(list(margins))
    scored = computed_once(
        features.withColumns(margins), {"predicted_label": label, "probability": probability}
    )
    return scored.drop(*margins)
