"""Column expressions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a C or Python "%.2f" prints 0.005, 0.015, ... 0.995: the tie goes by the binary
# value of the double, while the JVM formatter goes by its decimal text.
_TIE_HUNDREDTHS = [round(float(f"{k / 10000:.2f}") * 100) for k in range(50, 10000, 100)]


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, 0.0 for an empty whole."""
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.round(value, digits), F.lit(0.0))


def two_decimals(col: Column) -> Column:
    """Text of a value in [0, 1] that was rounded to four digits, with two decimals."""
    units = F.round(col * 10000).cast("int")
    ties = F.array(*[F.lit(v) for v in _TIE_HUNDREDTHS])
    hundredths = F.when(
        units % 100 == 50, F.get(ties, F.floor(units / 100).cast("int"))
    ).otherwise(F.floor((units + 50) / 100).cast("int"))
    return F.concat(
        F.floor(hundredths / 100).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
    )


def reading(col: Column, low: int = 0, high: int = 100) -> tuple[Column, Column]:
    """(value, missing flag) of a text reading; -1 and 1 when absent, not an integer or out of range."""
    number = F.when(col.rlike(r"^[+-]?[0-9]+$"), col.try_cast("bigint"))
    usable = number.between(low, high)
    value = F.when(usable, number).otherwise(F.lit(-1)).cast("int")
    return value, F.when(usable, F.lit(0)).otherwise(F.lit(1))


def softmax_top(margins: list[str]) -> tuple[Column, Column]:
    """(index of the first largest margin column, its softmax probability)."""
    top = f"greatest({', '.join(margins)})"
    index = " ".join(f"WHEN {m} = {top} THEN {k}" for k, m in enumerate(margins))
    total = " + ".join(f"exp({m} - {top})" for m in margins)
    return F.expr(f"CASE {index} END"), F.expr(f"1D / ({total})")
