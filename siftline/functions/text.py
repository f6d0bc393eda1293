"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space other than the blank: ASCII controls and separators, then the Unicode ones.
_ODD_SPACE = "\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = f"[{_ODD_SPACE}]"


def _maybe_odd(col: Column) -> Column:
    """False for lines that surely hold no white space but blanks: ASCII without controls.

    Byte searches cost a tenth of a pattern search, and most lines need nothing else.
    """
    test = F.octet_length(col) != F.char_length(col)
    for mark in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f":
        test = test | col.contains(mark)
    return test


def _blanks(col: Column) -> Column:
    """Every white-space character as a blank."""
    return F.when(_maybe_odd(col), F.regexp_replace(col, _ODD, " ")).otherwise(col)


def strip_text(col: Column) -> Column:
    """Drop white space of any kind at both ends."""
    ends = rf"^[ {_ODD_SPACE}]+|[ {_ODD_SPACE}]+$"
    return F.when(_maybe_odd(col), F.regexp_replace(col, ends, "")).otherwise(F.trim(col))


def words(col: Column) -> Column:
    """White-space tokens of a line. Splitting at a single blank needs no pattern."""
    return F.array_remove(F.split(_blanks(col), " "), "")


def word_tokens(col: Column) -> Column:
    """Lower-cased maximal runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(tokens: Column, max_n: int) -> Column:
    """All 1..max_n grams of a token array, joined by one space."""
    if max_n == 1:
        return tokens
    return F.concat(tokens, *[_grams(tokens, n) for n in range(2, max_n + 1)])


def _grams(tokens: Column, n: int) -> Column:
    last = F.size(tokens) - (n - 1)
    none = F.array().cast("array<int>")
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(none)
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


def sql_literal(value: str | bool | int | float) -> str:
    """SQL text of a constant."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def pick(name: str, mapping: dict) -> Column:
    """Value of a small fixed mapping for a named column; null for an unknown key."""
    arms = " ".join(f"WHEN {sql_literal(k)} THEN {sql_literal(v)}" for k, v in mapping.items())
    return F.expr(f"CASE {name} {arms} END")


def fill(template: str, *cols: Column) -> Column:
    """`%s` template filled with string columns; null when any of them is null."""
    pieces = template.split("%s")
    out = [F.lit(pieces[0])]
    for col, piece in zip(cols, pieces[1:], strict=True):
        out += [col, F.lit(piece)]
    return F.concat(*out)
