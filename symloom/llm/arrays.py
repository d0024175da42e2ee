"""Vectorised text primitives in numpy: words, lines, hashes and n-gram windows over many texts at once.

A piece is the UTF-8 bytes of some texts one after the other (data) and where each text begins and the last ends
(offsets, one more than texts). Nulls are empty texts. All 64-bit arithmetic wraps on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_IDS = _rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PIECE = 1 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, data, offsets) of consecutive texts of about limit bytes, a text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; those that a usual piece needs are kept."""
    held = _powers
    if len(held[0]) < n:
        held = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, PIECE + 1), base, np.uint64)
            p[0] = 1
            held.append(np.cumprod(p, dtype=np.uint64))
        if n <= PIECE + 1:
            _powers[:] = held
    return held[0][:n], held[1][:n]


def span_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of data[start:end] for each span, equal for equal bytes anywhere. Spans are in order and do not
    overlap; they are worked off in runs of about PIECE bytes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_IDS[data[a:b]] * up[:-1], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * ODD[63])
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and where each text's words begin among them (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    left, right = edge[:-1].copy(), edge[1:].copy()
    left[1:] |= ~solid[:-1]
    right[:-1] |= ~solid[1:]
    starts, ends = np.flatnonzero(solid & left), np.flatnonzero(solid & right) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (split at \\n; an empty text has an empty line), and where each text's begin."""
    breaks = np.flatnonzero(data == 10)
    text = np.searchsorted(offsets, breaks, "right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head = np.zeros(first[-1], bool)
    head[first[:-1]] = True
    tail = np.zeros(first[-1], bool)
    tail[first[1:] - 1] = True
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    return starts, ends, first


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of mask between consecutive offsets."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each item, from where each text's items begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(ids: np.ndarray, first: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of k items begin, and their identifiers; windows stay within a text. short: a text of fewer
    items has one window of all of them."""
    n = len(ids)
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(n)
    whole = at + k <= ends
    if short:
        whole |= (at == np.repeat(first[:-1], np.diff(first))) & (at + k > ends)
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for t in range(k):
        if short:
            held = at + t < ends[at]
            out += np.where(held, ids[np.minimum(at + t, n - 1)] * ODD[t % 60], U(0)) + held * ODD[61]
        else:
            out += ids[at + t] * ODD[t % 60] + ODD[61]
    return at, mix(out)


def distinct(ids: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of each text, sorted, and where each text's begin."""
    order = np.lexsort((ids, text))
    ids, text = ids[order], text[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (text[1:] != text[:-1])
    return ids[new], np.searchsorted(text[new], np.arange(n + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles of ASCII-lower-cased text as sorted 64-bit ids, and where each text's begin.
    A text of fewer than k words has its whole word sequence as its one shingle; one without words has none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    at, ids = windows(span_ids(data, starts, ends), first, k, short=True)
    return distinct(ids, np.searchsorted(first, at, "right") - 1, len(offsets) - 1)
