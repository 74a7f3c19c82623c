"""Texts of an Arrow batch as one byte buffer, cut into pieces of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy step works on (a longer single text is one piece).
PIECE = 2 << 20


def pieces(texts: pa.Array, limit: int = PIECE):
    """Yield ``(first, last, data, starts)``: rows first..last-1, their bytes, and offsets into them.

    ``starts`` has one more entry than rows. Null texts are empty.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if texts.null_count:
        # A null may cover bytes in principle; cut it out by rebuilding.
        texts = pa.array([x if x is not None else b"" for x in texts.to_pylist()], pa.large_binary())
        yield from pieces(texts, limit)
        return
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, whole[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def runs(mask: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True of at least ``least``; no run crosses a text's start."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(mask), bool)
    change[0] = True
    np.not_equal(mask[1:], mask[:-1], out=change[1:])
    inner = starts[(starts > 0) & (starts < len(mask))]
    change[inner] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(mask))
    keep = mask[at] & (ends - at >= least)
    return at[keep], ends[keep]
