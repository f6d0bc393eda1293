"""Cutting many texts into runs of wanted bytes at once, and checksums of the runs."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The lead byte of the two-byte characters U+00C0 to U+00FF.
LATIN_LEAD = 0xC3


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Map of bytes: those in the ranges (inclusive) stay, A-Z become lower case, others 0."""
    table = np.zeros(256, np.uint8)
    for low, high in ranges:
        table[low : high + 1] = np.arange(low, high + 1)
    capitals = np.arange(ord("A"), ord("Z") + 1)
    table[capitals] = capitals + 32
    return table


def cut_runs(texts: pa.Array, table: np.ndarray, latin: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of bytes that `table` keeps, mapped by it, and each text's bounds in them.

    With `latin` the two bytes of U+00C0 to U+00FF are kept as well. Runs do not pass from one
    text to the next; a null text has none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    mapped = table[data]
    if latin:
        lead = data == LATIN_LEAD
        lead[1:] |= lead[:-1]
        mapped = np.where(lead, data, mapped)
    kept = mapped != 0
    breaks = ends[:-1][ends[:-1] < len(data)]
    opens, closes = kept.copy(), kept.copy()
    opens[1:] &= ~kept[:-1]
    opens[breaks] = kept[breaks]
    closes[:-1] &= ~kept[1:]
    last = breaks[breaks > 0] - 1
    closes[last] = kept[last]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(mapped[kept])])
    return runs, np.searchsorted(starts, ends)


def checksums(values: list[bytes]) -> np.ndarray:
    """Unsigned crc32 of each value."""
    return np.fromiter(map(zlib.crc32, values), np.int64, len(values))


def _one_byte_steps() -> np.ndarray:
    """What a zero byte does to the lowest eight bits of a checksum."""
    steps = np.arange(256, dtype=np.int64)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ 0xEDB88320, steps >> 1)
    return steps


_STEPS = _one_byte_steps()


def shifted_checksums(sums: np.ndarray, most: int) -> np.ndarray:
    """Row n: the checksums moved on by n zero bytes, for n up to `most`.

    crc32(a + b) is the checksum of a moved on by len(b) bytes, exclusive-or the one of b.
    """
    rows = [sums]
    for _ in range(most):
        rows.append((rows[-1] >> 8) ^ _STEPS[rows[-1] & 255])
    return np.stack(rows)
