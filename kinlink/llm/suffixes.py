"""Exact substring dedup by suffix arrays in a logarithmic family of levels.

Two 50-byte strings are equal only if they have the same smallest 8-byte gram
(by hash, first place on ties), so every 50-byte suffix start of a text belongs
to one anchor.  Runs of starts with one anchor travel together as a context (the
bytes they cover) to the anchor's bucket; no position travels alone.  A first pass
weighs the anchors: grams of which the contexts would fill a bucket or more are then
taken only where a string has no other gram, so that no bucket outgrows a task.

A bucket first joins whole equal contexts; then 64-bit fingerprints leave out
starts whose string surely occurs once.  The rest is sorted into suffix arrays
(by their 50 bytes), batch by batch in ascending doc_id: a new batch is merge-
scanned against the levels there are; its own starts that meet an equal string of
a smaller doc_id are removed; it then becomes a level, and equal-sized levels
merge, so a start is merged a logarithmic number of times.  Comparison is by
bytes: no match is taken from a hash alone.

Skew: a chunk of texts settles equal contexts itself first (see ``spans``).

Defined results: a null text counts as empty; texts under 50 bytes keep all;
repeats within one document stay, as do repeats among rows of one doc_id (which are
told apart by 16 bits of their texts' hashes); rows with a null doc_id keep all and remove nothing elsewhere; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinlink.llm.scratch import tables
from kinlink.llm.words import tidy
from kinlink.llm.spans import Chunk, chunks, doc_table, lost_rows, pack, remove_repeats, steps, unpack

LENGTH, GRAM = 50, 8
SPAN = LENGTH - GRAM + 1
#: Bytes of contexts that a bucket is meant to hold, and starts of a batch.
BUCKET, BATCH = 12 << 20, 1 << 15
#: Long texts are read in pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 20
SLICE = 1 << 18
_PLACE = np.uint64(24)


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    n = len(data) - 7
    out = np.empty(max(n, 0), dtype=np.uint64)
    for o in range(min(8, max(n, 0))):
        m = (len(data) - o) // 8
        out[o::8] = np.frombuffer(data[o:o + 8 * m].tobytes(), dtype=np.uint64)
    return out


def anchors(data: np.ndarray, heavy: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each start of LENGTH bytes: place of its anchor; and the grams' hashes.

    ``heavy`` tells by the hash, modulo its size (a power of two), which grams come last.
    """
    gram = words8(data) * np.uint64(0x9E3779B97F4A7C15)
    gram = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)
    if heavy is not None:
        gram |= heavy[(gram >> _PLACE) & np.uint64(len(heavy) - 1)].astype(np.uint64) << np.uint64(63)
    low = ((gram >> _PLACE) << _PLACE) | np.arange(len(gram), dtype=np.uint64)
    for s in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-s], low[s:])
    low = np.minimum(low[:-(SPAN - 32)], low[SPAN - 32:])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64), gram >> _PLACE


def _pieces(c: Chunk) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (document, place, bytes) of about PIECE bytes."""
    group, size = [], 0
    for d, text in enumerate(c.texts):
        if len(text) < LENGTH:
            continue
        for lo in range(0, len(text) - LENGTH + 1, PIECE):
            part = text if len(text) <= PIECE else text[lo:lo + PIECE + LENGTH - 1]
            group.append((d, lo, part))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def contexts(c: Chunk, heavy: np.ndarray | None = None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group: its bytes; document, place in it, from, to, anchor hash of contexts."""
    for group in _pieces(c):
        raw = b"".join(p for _, _, p in group)
        data = np.frombuffer(raw, dtype=np.uint8)
        sizes = np.array([len(p) for _, _, p in group])
        begin = np.cumsum(sizes) - sizes
        anchor, grams = anchors(data, heavy)
        ok = np.ones(len(anchor), dtype=bool)
        for e in (begin + sizes)[:-1].tolist():
            ok[e - LENGTH + 1:e] = False
        at = np.flatnonzero(ok)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        qs, qe = at[first], at[np.append(first[1:], len(at)) - 1]
        part = np.searchsorted(begin, qs, "right") - 1
        doc, place = np.array([d for d, _, _ in group]), np.array([lo for _, lo, _ in group])
        yield raw, doc[part], qs - begin[part] + place[part], qs, qe + LENGTH, grams[anchor[qs]]


@tidy
def _weigh(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """Bytes of contexts by slot of their anchors' hashes."""
    total = np.zeros(slots, dtype=np.int64)
    for c in chunks(batches):
        for _, _, _, lo, hi, gram in contexts(c):
            total += np.bincount((gram & np.uint64(slots - 1)).astype(np.int64), weights=hi - lo, minlength=slots).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "bytes"])


@tidy
def _emit(batches: Iterator[pa.RecordBatch], buckets: int, heavy: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for c in chunks(batches):
        seen: dict[bytes, int] = {}
        found, docs, starts, grams = [], [], [], []
        lost_doc, lost_start, lost_size, lost_gram = [], [], [], []
        ids = c.ids.tolist()
        for raw, doc, start, lo, hi, gram in contexts(c, heavy):
            for d, s, a, b, g in zip(doc.tolist(), start.tolist(), lo.tolist(), hi.tolist(), gram.tolist()):
                text = raw[a:b]
                owner = seen.setdefault(text, d)
                if owner == d or ids[owner] == ids[d]:
                    found.append(text)
                    docs.append(d)
                    starts.append(s)
                    grams.append(g)
                else:
                    lost_doc.append(d)
                    lost_start.append(s)
                    lost_size.append(b - a)
                    lost_gram.append(g)
        del seen
        if not found:
            continue
        size = np.array(list(map(len, found)) + lost_size, dtype=np.int64)
        doc, start = np.array(docs + lost_doc), np.array(starts + lost_start, dtype=np.int64)
        keep = np.arange(len(size)) < len(found)
        bucket = (np.array(grams + lost_gram, dtype=np.uint64) % np.uint64(buckets)).astype(np.int64)
        sort = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[sort], prepend=-1))
        keys, blobs = [], []
        for a, b in zip(edge, [*edge[1:], len(sort)]):
            at = sort[a:b]
            small, (i, t) = doc_table(doc[at], c.ids, c.tags)
            keys.append(int(bucket[at[0]]))
            blobs.append(pack(steps(i), t, keep[at], steps(small), start[at].astype(np.uint32), size[at].astype(np.uint8), b"".join([found[i] for i in at[keep[at]].tolist()])))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


class LogIndex:
    """Suffix arrays of LENGTH-byte starts in levels of doubling size."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray] | None] = []

    def insert(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Add a batch; True for its starts that a smaller doc_id also has.

        Batches must come in ascending order of doc_id.
        """
        order = np.lexsort((docs, keys))
        k, d = keys[order], docs[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        k, low = k[new], d[new]
        least = low.copy()
        for level in self.levels:
            if level is not None:
                at = np.minimum(np.searchsorted(level[0], k), len(level[0]) - 1)
                least = np.where(level[0][at] == k, np.minimum(least, level[1][at]), least)
        hit = np.zeros(len(keys), dtype=bool)
        hit[order] = least[group] < d
        fresh, slot = (k, least), 0
        while slot < len(self.levels) and self.levels[slot] is not None:
            fresh, self.levels[slot] = self._merge(self.levels[slot], fresh), None
            slot += 1
        if slot == len(self.levels):
            self.levels.append(None)
        self.levels[slot] = fresh
        return hit

    @staticmethod
    def _merge(a, b):
        k, d = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(k, kind="stable")
        k, d = k[order], d[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        return k[new], np.minimum.reduceat(d, np.flatnonzero(new))


def repeated_starts(text: bytes, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of ``size`` bytes in ``text``, owned by ``docs``: (context, place) of
    the starts whose string also starts in a context of a smaller doc_id."""
    n = size - LENGTH + 1
    begin = np.cumsum(size) - size
    which = np.repeat(np.arange(len(size), dtype=np.int32), n)
    at = np.repeat((begin - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(len(which), dtype=np.int32)
    data, mark = np.frombuffer(text, dtype=np.uint8), np.empty(len(at), dtype=np.uint64)
    for lo in range(0, len(at), SLICE):  # in slices: the bucket's words would take its bytes eightfold
        some = at[lo:lo + SLICE]
        w = words8(data[some[0]:some[-1] + LENGTH])
        some = some - some[0]
        h = w[some]
        for j, by in zip((8, 16, 24, 32, 40, 42), (3, 5, 7, 9, 11, 13)):
            h = (h * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(31))) + w[some + j] * np.uint64(2 * by + 1)
        mark[lo:lo + SLICE] = h
    order = np.argsort(mark).astype(np.int32)
    mark = mark[order]
    same = mark[1:] == mark[:-1]
    del mark
    twice = np.zeros(len(order), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    at, which = at[twice].astype(np.int64), which[twice].astype(np.int64)
    place = at - begin[which]
    order = np.argsort(docs[which], kind="stable")
    hit, index = np.zeros(len(at), dtype=bool), LogIndex()
    lane = np.arange(LENGTH)
    for lo in range(0, len(order), BATCH):
        some = order[lo:lo + BATCH]
        keys = data[at[some][:, None] + lane].view(f"S{LENGTH}").ravel()
        hit[some] = index.insert(keys, docs[which[some]])
    return which[hit], place[hit]


_KINDS = (np.int64, np.uint16, np.bool_, np.int32, np.uint32, np.uint8)


def _settle(rows: pa.Table, homes: int) -> pa.Table:
    cols, base, number, texts, context = [[] for _ in _KINDS], 0, {}, [], []
    for blob in rows["blob"].to_pylist():
        *got, text = unpack(blob)
        got = [np.frombuffer(x, dtype=k) for x, k in zip(got, _KINDS)]
        got[0] = np.cumsum(got[0])
        got[3] = np.cumsum(got[3], dtype=np.int64) + base
        base += len(got[0])
        at = 0
        for size in got[5][got[2]].tolist():
            context.append(number.setdefault(text[at:at + size], len(number)))
            at += size
        for to, x in zip(cols, got):
            to.append(x)
    ids, tags, keep, doc, start, size = map(np.concatenate, cols)
    start, size, sent = start.astype(np.int64), size.astype(np.int64), np.flatnonzero(keep)
    context = np.array(context, dtype=np.int64)
    owner = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(owner, context, ids[doc[sent]])
    later = ids[doc[sent]] > owner[context]
    text, sizes = b"".join(number), np.fromiter(map(len, number), dtype=np.int64, count=len(number))
    del number
    whole = np.concatenate([np.flatnonzero(~keep), sent[later]])
    out = [(doc[whole], start[whole], size[whole])]
    which, place = repeated_starts(text, sizes, owner)
    if len(which):
        # Runs of removed starts within a context, for each row that owns it.
        order = np.lexsort((place, which))
        which, place = which[order], place[order]
        new = np.ones(len(which), dtype=bool)
        new[1:] = (np.diff(which) != 0) | (np.diff(place) != 1)
        first = np.flatnonzero(new)
        run = which[first], place[first], place[np.append(first[1:], len(which)) - 1] - place[first] + LENGTH
        mine = np.flatnonzero(~later)
        mine = mine[np.argsort(context[mine], kind="stable")]
        lo, hi = np.searchsorted(context[mine], run[0], "left"), np.searchsorted(context[mine], run[0], "right")
        many = hi - lo
        r = np.repeat(np.arange(len(many)), many)
        row = sent[mine[np.repeat(lo, many) + np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)]]
        out.append((doc[row], start[row] + run[1][r], run[2][r]))
    d, s, n = (np.concatenate(x) for x in zip(*out))
    return lost_rows(d, s, n, ids, tags, homes)


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs`` (doc_id, text)."""
    return remove_repeats(docs, _emit, _settle, 2.9, BUCKET, _weigh)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(tables(spark, sf_dir, "documents"))
