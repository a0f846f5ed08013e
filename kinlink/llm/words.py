"""Word and shingle hashes of whole texts, vectorised over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Words are maximal runs of bytes outside these, so bytes above 0x7F are letters.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Token breaks for search: every ASCII byte but letters and digits.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[:128] = True
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 1 << 12
_POWER = np.cumprod(np.full(_SPAN, 0x9E3779B97F4A7C15, dtype=np.uint64))
#: Bytes that are hashed at once, and texts that are handled at once.
PIECE, BLOCK = 1 << 20, 4 << 20


def give_back() -> None:
    """Return memory that Arrow and the allocator keep of work that is done.

    Python workers live on from task to task, and so does the driver.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(batches: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """For functions over batches: what they held is given back at the end of a partition."""

    @functools.wraps(batches)
    def run(*args, **more) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(*args, **more)
        finally:
            give_back()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and offsets; a null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw, offs


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first, end, bytes, offsets)."""
    raw, offs = utf8(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def _cuts(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray) -> list[int]:
    """Places where no word is cut, about PIECE bytes apart."""
    cuts, n = [0], len(data)
    while cuts[-1] < n:
        at, to = cuts[-1], cuts[-1] + PIECE
        if to >= n:
            cuts.append(n)
            break
        doc = int(offs[np.searchsorted(offs, to, "right") - 1])
        if doc <= at:
            gap = np.flatnonzero(gaps[data[at + 1:to]])
            if len(gap):
                doc = at + 1 + int(gap[-1])
            else:  # one very long word
                end = int(offs[np.searchsorted(offs, to, "right")])
                gap = np.flatnonzero(gaps[data[to:end]])
                doc = to + int(gap[0]) if len(gap) else end
        cuts.append(doc)
    return cuts


def word_spans(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Per piece: starts and ends of words within the piece, the piece, its place."""
    cuts = _cuts(data, offs, gaps)
    for lo, hi in zip(cuts, cuts[1:]):
        piece = data[lo:hi]
        solid = ~gaps[piece]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        a, b = np.searchsorted(offs, [lo, hi])
        edge = offs[a:b] - lo
        edge = edge[edge < hi - lo]
        first[edge] = solid[edge]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        before = edge[edge > 0] - 1
        last[before] = solid[before]
        yield np.flatnonzero(first), np.flatnonzero(last) + 1, piece, lo


def word_hashes(data: np.ndarray, offs: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text."""
    out, counts = [], np.zeros(len(offs) - 1, dtype=np.int64)
    for s, e, piece, lo in word_spans(data, offs, gaps):
        if not len(s):
            continue
        size = e - s
        reach = np.arange(len(piece), dtype=np.int64)
        reach[:s[0]] = 0
        reach[s[0]:] -= np.repeat(s, np.diff(np.append(s, len(piece))))
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[piece] * _POWER[reach & (_SPAN - 1)], out=total[1:])
        out.append(mix(total[e] - total[s] + size.astype(np.uint64)))
        counts += np.bincount(np.searchsorted(offs, lo + s, "right") - 1, minlength=len(counts))
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), counts


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingles(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order and their number for each text.

    A text of 1 to k - 1 words has its whole sequence as its only shingle.
    """
    w = _weights(k)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(n.sum()), dtype=np.uint64)
    start, at = np.cumsum(counts) - counts, np.cumsum(n) - n
    if len(words) >= k:
        m = len(words) - k + 1
        h = words[:m] * w[0]
        for j in range(1, k):
            h = h + words[j:m + j] * w[j]
        long = counts >= k
        valid = np.repeat(start[long], n[long]) + (np.arange(int(n[long].sum())) - np.repeat(np.cumsum(n[long]) - n[long], n[long]))
        to = np.repeat(at[long], n[long]) + (valid - np.repeat(start[long], n[long]))
        out[to] = h[valid]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        c = int(counts[d])
        out[at[d]] = np.append(words[start[d]:start[d] + c] * w[:c], np.uint64(c << 60 | c)).sum(dtype=np.uint64)
    return mix(out), n
