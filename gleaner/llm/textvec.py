"""Numpy views of Arrow text columns: chunks of rows, word spans and span hashes.

Everything here works on the UTF-8 bytes of many rows at once, so a task's cost
per byte is a handful of array passes, and memory is bounded by the chunk size
(a single longer text is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)  # ASCII letters and every byte of a longer UTF-8 sequence
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_MUL))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, m in enumerate((_MUL, _INV)):
            x = np.full(max(n, CHUNK_BYTES + 64), m, np.uint64)
            x[0] = 1
            _POWERS[i] = np.multiply.accumulate(x)
    return _POWERS


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary() if pa.types.is_large_binary(column.type) else pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def stretches(buf: np.ndarray, breaks: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of about ``limit`` bytes of a text, each but the last ended by a byte that ``breaks`` (256 booleans)
    marks. A longer run without such a byte stays whole."""
    limit = limit or CHUNK_BYTES
    at, n = 0, len(buf)
    while at < n:
        to = at + limit
        if to >= n:
            to = n
        else:
            for a in range(to - 1, at, -4096):
                found = np.flatnonzero(breaks[buf[max(a - 4095, at) : a + 1]])
                if len(found):
                    to = max(a - 4095, at) + int(found[-1]) + 1
                    break
            else:
                while to < n and not breaks[buf[to - 1]]:
                    found = np.flatnonzero(breaks[buf[to : to + limit]])
                    to = to + int(found[0]) + 1 if len(found) else min(n, to + limit)
        yield at, to
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``inside``, never across rows."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Running polynomial hash (modulo 2**64) from which any span's hash follows."""
    p, _ = _powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; the same bytes hash alike wherever they stand."""
    _, inv = _powers(len(h))
    return _mix((h[ends] - h[starts]) * inv[starts] + np.uint64(_MUL) * (ends - starts).astype(np.uint64))


def crc32_text(column: str) -> str:
    """SQL for crc32 of an id written as text (null: of the empty string)."""
    return f"crc32(cast(coalesce(cast({column} as string), '') as binary))"


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be none of the columns (without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
