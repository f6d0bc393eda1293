"""Digest expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANES = 8
_LANE_HEX = 8


def row_digest(*cols: Column) -> Column:
    """sha256 of a row; fields are joined with a separator so that they cannot run together."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def lane_sums(digest: Column, keep: Column | None = None) -> list[Column]:
    """Aggregates that add up each 32-bit lane of a hex digest.

    The sums do not depend on row order, count duplicates, and merge map-side, so a
    fingerprint of any number of rows never gathers the rows themselves.
    """
    out = []
    for lane in range(LANES):
        part = F.conv(F.substring(digest, 1 + lane * _LANE_HEX, _LANE_HEX), 16, 10)
        value = part.cast("decimal(20,0)")
        out.append(F.sum(value if keep is None else F.when(keep, value)))
    return out


def fingerprint(count: Column, lanes: list[Column]) -> Column:
    """sha256 of the row count and the lane sums."""
    texts = [F.coalesce(lane.cast("string"), F.lit("0")) for lane in lanes]
    return F.sha2(F.concat_ws("|", count.cast("string"), *texts), 256)
