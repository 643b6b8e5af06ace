"""Whole texts as flat byte buffers: the layout the NumPy operators work on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # every byte costs up to a hundred of arrays while it is worked on; workers keep the most they had
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and ``n + 1`` offsets into them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def slices(
    texts: pa.Array, limit: int = SLICE_BYTES, rows: int = 4096
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes: first row, end row, bytes, offsets.

    A text is never cut; one longer than the limit is a run of its own.
    """
    body, at = flat(texts)
    lo = 0
    while lo < len(at) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1), lo + rows)
        yield lo, hi, body[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def strings(body: np.ndarray, at: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow array over a buffer and offsets, without copying the bytes."""
    return pa.Array.from_buffers(
        kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)]
    )


def words(
    body: np.ndarray, at: np.ndarray, members: np.ndarray = ~BLANKS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of member bytes (by default no ASCII blank): starts, ends, their text's row.

    Texts are neighbours in ``body``, so a run also ends where a text ends.
    """
    inside = members[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[at] = True
    before = np.zeros(len(body), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(body), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def pieces(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte runs ``[start, end)`` as an Arrow array."""
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return strings(body[spread(starts, sizes)], at)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices ``start, start + 1, ...`` of every run, one run after another."""
    total = int(sizes.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
