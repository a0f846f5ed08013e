"""Substring dedup by content-defined chunking with a gear rolling hash.

A text is cut where the gear hash of the last 32 bytes has its top bits zero,
at least ``LEAST`` and at most ``MOST`` bytes apart.  Cuts follow content, so an
insertion moves them only nearby.  Chunks of at least ``LEAST`` bytes are
deduplicated by 128-bit digest: the occurrence with the smallest (doc_id, place)
stays, all others are removed, within one document too.  The end of a text that
is shorter than ``LEAST`` always stays.

Skew: a chunk of texts settles its own repeats first (see ``spans``).

Defined results: a null text counts as empty; texts shorter than ``LEAST`` keep
all; rows with a null doc_id keep all and are nobody's first occurrence; rows
of one doc_id and equal text get equal results (they count as one document);
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.scratch import tables
from kinlink.llm.words import tidy
from kinlink.llm.spans import chunks, doc_table, lost_rows, pack, remove_repeats, unpack

LEAST, MOST, BITS = 32, 512, 5
GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)
_SEGMENT = 1 << 20


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over the last 32 bytes."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        late = h[s:] + (h[:-s] << np.uint32(s))
        h = np.concatenate([h[:s], late]) if len(h) > s else h
    return h


def cut_points(text: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    data, marks = np.frombuffer(text, dtype=np.uint8), []
    for lo in range(0, len(data), _SEGMENT):
        back = min(lo, 31)
        h = gear_hash(data[lo - back:lo + _SEGMENT])[back:]
        marks += (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + (lo + 1)).tolist()
    out, at, n = [], 0, len(text)
    while at < n:
        k = bisect.bisect_left(marks, at + LEAST)
        at = min(marks[k] if k < len(marks) else n, at + MOST, n)
        out.append(at)
    return out


def _first(hi, lo, ids, place):
    """Order by digest, then (doc_id, place), and where a new digest begins."""
    order = np.lexsort((place, ids, lo, hi))
    h, low = hi[order], lo[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
    return order, new


@tidy
def _emit(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        digests, doc, start, size = [], [], [], []
        for d, text in enumerate(c.texts):
            at, view = 0, memoryview(text)
            for end in cut_points(text):
                if end - at >= LEAST:
                    digests.append(hashlib.blake2b(view[at:end], digest_size=16).digest())
                    doc.append(d)
                    start.append(at)
                    size.append(end - at)
                at = end
        if not digests:
            continue
        both = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        hi, lo = both[:, 0], both[:, 1]
        doc, start, size = np.array(doc), np.array(start, dtype=np.int64), np.array(size, dtype=np.int64)
        order, new = _first(hi, lo, c.ids[doc], start)
        # Rows of one doc_id and one text are one document: none removes the other.
        owner = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        twin = ~new & (c.ids[doc[order]] == c.ids[doc[owner]]) & (start[order] == start[owner]) & (c.tags[doc[order]] == c.tags[doc[owner]])
        lost = np.zeros(len(order), dtype=bool)
        lost[order] = ~new & ~twin
        keep = np.zeros(len(order), dtype=bool)
        keep[order] = new
        bucket = (hi % np.uint64(buckets)).astype(np.int64)
        sort = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[sort], prepend=-1))
        keys, blobs = [], []
        for a, b in zip(edge, [*edge[1:], len(sort)]):
            at = sort[a:b]
            at = at[keep[at] | lost[at]]
            if len(at):
                small, cols = doc_table(doc[at], c.ids, c.tags)
                k = keep[at]
                keys.append(int(bucket[at[0]]))
                blobs.append(pack(*cols, k, small, start[at], size[at].astype(np.uint16), hi[at][k], lo[at][k]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


_KINDS = (np.int64, np.uint16, np.bool_, np.int32, np.int64, np.uint16, np.uint64, np.uint64)


def _settle(rows: pa.Table, homes: int) -> pa.Table:
    cols, base = [[] for _ in _KINDS], 0
    for blob in rows["blob"].to_pylist():
        got = [np.frombuffer(x, dtype=k) for x, k in zip(unpack(blob), _KINDS)]
        got[3] = got[3].astype(np.int64) + base
        base += len(got[0])
        for to, x in zip(cols, got):
            to.append(x)
    ids, tags, keep, doc, start, size, hi, lo = map(np.concatenate, cols)
    at = np.flatnonzero(keep)
    order, new = _first(hi, lo, ids[doc[at]], start[at])
    owner = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    d, o = doc[at[order]], doc[at[owner]]
    twin = (ids[d] == ids[o]) & (tags[d] == tags[o]) & (start[at[order]] == start[at[owner]])
    lost = np.concatenate([np.flatnonzero(~keep), at[order[~new & ~twin]]])
    return lost_rows(doc[lost], start[lost], size[lost].astype(np.int64), ids, tags, homes)


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs`` (doc_id, text)."""
    return remove_repeats(docs, _emit, _settle, 32 / 64, 8 << 20)


def op9_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(tables(spark, sf_dir, "documents"))
