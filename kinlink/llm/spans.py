"""Shared parts of the two substring operators: packed exchange and removal.

Digests or contexts travel in blobs, one per content bucket and chunk of texts,
never one row each; removed spans travel back in blobs per document bucket.
Chunks settle repeats among themselves before the exchange, so that a passage in
a third of all documents costs one entry per chunk of texts and not per document.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.words import give_back, tidy, utf8

#: Bytes of text that a map task settles at once, and of text in a document bucket.
CHUNK, HOME = 8 << 20, 6 << 20

OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def pack(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(struct.pack(f"<{len(raw) + 1}q", len(raw), *map(len, raw)) + b"".join(raw), 3)


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}q", raw, 8):
        out.append(raw[at:at + size])
        at += size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress well where ``x`` ascends."""
    return np.diff(x, prepend=x.dtype.type(0))


def prime(n: int) -> int:
    """The smallest prime from ``n`` on, so that doc_ids with a common step spread."""
    while n < 2 or any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


class Chunk:
    """Texts in ascending doc_id order: id, tag (16 bits of the text's hash), bytes."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        rows.sort(key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.tags = np.array([r[1] for r in rows], dtype=np.uint16)
        self.texts = [r[2] for r in rows]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK) -> Iterator[Chunk]:
    """Columns: doc_id, tag, text.  Rows without doc_id or text are left out."""
    rows, size = [], 0
    for b in batches:
        ids, tags = b.column(0).to_pylist(), b.column(1).to_pylist()
        raw, offs = utf8(b.column(2))
        view, offs = memoryview(raw), offs.tolist()
        for i, doc in enumerate(ids):
            if doc is None or offs[i] == offs[i + 1]:
                continue
            rows.append((doc, tags[i], bytes(view[offs[i]:offs[i + 1]])))
            size += offs[i + 1] - offs[i]
            if size >= limit:
                yield Chunk(rows)
                rows, size = [], 0
                # Workers live on: give back what Arrow keeps of earlier batches.
                give_back()
    if rows:
        yield Chunk(rows)


def doc_table(doc: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``doc`` renumbered over the documents that occur, and their columns."""
    used, small = np.unique(doc, return_inverse=True)
    return small.astype(np.int32), [c[used] for c in columns]


def lost_rows(doc: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, tags: np.ndarray, homes: int) -> pa.Table:
    """Removed spans as blobs by home bucket; ``doc`` indexes ids and tags."""
    home = np.mod(ids[doc], homes)
    order = np.argsort(home, kind="stable")
    edge = np.flatnonzero(np.diff(home[order], prepend=-1))
    out_home, out_blob = [], []
    for lo, hi in zip(edge, [*edge[1:], len(order)]):
        at = order[lo:hi]
        d, (i, t) = doc_table(doc[at], ids, tags)
        out_home.append(int(home[at[0]]))
        out_blob.append(pack(i, t, d, start[at].astype(np.int64), length[at].astype(np.int64)))
    return pa.table({"home": pa.array(out_home, pa.int64()), "blob": pa.array(out_blob, pa.binary())})


@tidy
def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, tag, home, text -> home, blob of many documents."""
    held: dict[int, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        blobs = []
        for docs in held.values():
            null = np.array([d[0] is None for d in docs])
            blobs.append(pack(null, np.array([d[0] or 0 for d in docs], dtype=np.int64), np.array([d[1] for d in docs], dtype=np.uint16),
                              np.array([len(d[2]) for d in docs], dtype=np.int64), b"".join([d[2] for d in docs])))
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary())], ["home", "texts"])
        held.clear()
        return out

    for b in batches:
        raw, offs = utf8(b.column(3))
        view, offs = memoryview(raw), offs.tolist()
        for i, (doc, tag, home) in enumerate(zip(*(b.column(k).to_pylist() for k in range(3)))):
            held.setdefault(home, []).append((doc, tag, bytes(view[offs[i]:offs[i + 1]])))
            size += offs[i + 1] - offs[i] + 64
            if size >= CHUNK:
                yield flush()
                size = 0
                give_back()
    if held:
        yield flush()


def _texts(blobs: list[bytes]) -> Iterator[tuple[int | None, int, bytes]]:
    for blob in blobs:
        null, ids, tags, sizes, text = unpack(blob)
        at = 0
        for empty, i, t, n in zip(np.frombuffer(null, dtype=np.bool_), np.frombuffer(ids, dtype=np.int64).tolist(), np.frombuffer(tags, dtype=np.uint16).tolist(), np.frombuffer(sizes, dtype=np.int64).tolist()):
            yield None if empty else i, t, text[at:at + n]
            at += n


def _finish(docs: pa.Table, lost: pa.Table) -> pa.Table:
    give_back()
    parts = [[], [], [], []]
    for blob in lost["blob"].to_pylist():
        i, t, d, s, n = unpack(blob)
        d = np.frombuffer(d, dtype=np.int32)
        for to, x in zip(parts, (np.frombuffer(i, dtype=np.int64)[d], np.frombuffer(t, dtype=np.uint16)[d].astype(np.int64), np.frombuffer(s, dtype=np.int64), np.frombuffer(n, dtype=np.int64))):
            to.append(x)
    ids, tags, start, size = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts)
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order], (start + size)[order]
    edge = np.flatnonzero((np.diff(ids, prepend=0) != 0) | (np.diff(tags, prepend=0) != 0) | (np.arange(len(ids)) == 0))
    where = {(int(ids[lo]), int(tags[lo])): (lo, hi) for lo, hi in zip(edge, [*edge[1:], len(ids)])}
    rows = []
    for doc, tag, text in _texts(docs["texts"].to_pylist()):
        runs = []
        if doc is not None and (span := where.get((doc, tag))) is not None:
            lo, hi = span
            s, e = start[lo:hi], np.maximum.accumulate(end[lo:hi])
            fresh = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
            runs = list(zip(s[fresh].tolist(), e[np.append(fresh[1:], len(s)) - 1].tolist()))
        kept, at = hashlib.sha256(), 0
        for a, b in runs:
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        rows.append((doc, len(text), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n_bytes": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()),
                     "n_spans": pa.array(cols[3], pa.int64()), "kept_sha256": pa.array(cols[4], pa.string())})


def heavy_slots(rows: DataFrame, weigh: Callable, slots: int, limit: float) -> np.ndarray:
    """Which slots weigh more than ``limit``; only these come to the driver."""
    weights = rows.mapInArrow(lambda b: weigh(b, slots), "slot bigint, bytes bigint").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    out = np.zeros(slots, dtype=bool)
    out[[r["slot"] for r in weights.filter(F.col("bytes") > limit).collect()]] = True
    return out


def remove_repeats(docs: DataFrame, emit: Callable, settle: Callable, growth: float, bucket_bytes: int, weigh: Callable | None = None) -> DataFrame:
    """Rows OUT for every row of ``docs`` (doc_id, text).

    ``emit(batches, buckets)`` yields (bucket, blob) batches, ``settle(table,
    homes)`` turns a bucket's blobs into ``lost_rows``.  ``growth``: bytes in
    buckets for each byte of text; a bucket holds about ``bucket_bytes``.  With
    ``weigh(batches, slots)``, which yields (slot, bytes), emit also gets the slots
    that outweigh half a bucket and four times the mean; a quarter of them at most.
    """
    total = docs.agg(F.sum(F.octet_length("text").cast("bigint")).alias("b")).first()["b"] or 0
    buckets, homes = max(1, round(total * growth / bucket_bytes)), prime(total // HOME + 1)
    tag = F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("int")
    home = F.coalesce(F.pmod(F.col("doc_id").cast("bigint"), F.lit(homes)), F.pmod(F.xxhash64("text"), F.lit(homes)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tag.alias("tag"), home.cast("bigint").alias("home"), "text")
    known = rows.select("doc_id", "tag", "text")
    more = ()
    if weigh is not None:
        slots = 1 << min(24, max(16, (8 * buckets).bit_length()))
        more = (heavy_slots(known, weigh, slots, max(bucket_bytes / 2, 4 * growth * total / slots)),)
    sent = known.mapInArrow(lambda b: emit(b, buckets, *more), "bucket bigint, blob binary")
    lost = sent.groupBy("bucket").applyInArrow(lambda t: settle(t, homes), "home bigint, blob binary")
    texts = rows.mapInArrow(_pack_texts, "home bigint, texts binary")
    return texts.groupBy("home").cogroup(lost.groupBy("home")).applyInArrow(_finish, OUT)
