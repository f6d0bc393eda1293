"""Computing an expensive column once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters refer to instead of repeating.

    Filters move below a projection by copying the expressions they use, which for a
    chain of derived columns multiplies the work and the plan. A one-element generator
    stays inside the same codegen stage, and filters on its output do not pass it.
    """
    row = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    replaced = [name for name in columns if name in df.columns]
    if not replaced:
        return df.select("*", row)
    return df.select(*[c for c in df.columns if c not in replaced], row)
