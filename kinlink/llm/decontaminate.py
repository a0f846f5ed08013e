"""Benchmark decontamination: complete seeds, q-gram counts, edit verification.

Texts and items are compared as lower-case (A-Z) words joined by one space.  An
item of m bytes leaks where a part of a text is within e = RATIO * m edits.

1. Seeds: an item is cut into e + 1 pieces of nearly equal size.  e edits leave at
   least one piece whole (pigeonhole), so every leak holds a piece byte by byte, at
   most e bytes away from its place in the item.  Nothing is sampled.
2. Windows: the item's place by a seed, widened by e bytes on both sides and by the
   width of the bucket that nearby places share; it holds the whole leak, inserted
   and removed bytes included.
3. Counts: an edit spoils at most ``GRAM`` of an item's ``GRAM``-byte grams, so
   windows without m - GRAM + 1 - GRAM * e of them are left out.  Hashed to
   ``PRINT`` bits, which can only let more windows pass.
4. What remains is verified exactly: the smallest edit distance between the item
   and any part of the window must be at most e.

So all leaks within RATIO are found.  CGK walks and sampled keys over item-sized
windows can't give that here: with edits of 10 % of the bytes spread evenly over the
benchmark's items the walks differ in 59 % of their places, and 64 keys of 6 places
in 4 walks find 59 % of the leaks, even where windows begin at the right byte; keys of
3 places would find them and also several unrelated items at every window.

Every row is decided on its own row; nothing is shuffled.  Items are broadcast in
blocks of at most ``ITEM_BYTES``; larger benchmarks take several passes.

Defined results: null and empty texts match nothing; items that are null or have under
``LEAST_WORDS`` words and ``LEAST_BYTES`` bytes match nothing; equal items each match; repeated rows each
match; an empty table or benchmark gives an empty result; null ids are carried;
further columns are ignored by ``find_leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm.scratch import keeps_names, tables
from kinlink.llm.words import LOWER, SPACES, blocks, tidy

#: Items of fewer words and fewer bytes match nothing; scripts without spaces have one word.
LEAST_WORDS, LEAST_BYTES, RATIO = 3, 24, 0.1
GRAM, PRINT = 4, 1 << 12
ITEM_BYTES = 16 << 20
#: Bytes of text that are searched at once, and windows that are counted at once.
PIECE, LOT = 1 << 20, 4096

_NORMAL = LOWER.copy()
_NORMAL[SPACES] = 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_at(data: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian number of ``kind`` from each byte on; ``data`` is padded for it."""
    return np.ndarray((len(data) - 8,), dtype=kind, buffer=data, strides=(1,))


def squeezed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words joined by one space (one may trail), padded by 8 bytes; offsets; what is kept."""
    space = SPACES[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    keep[offs[full]] = ~space[offs[full]]
    size = np.zeros(len(offs), dtype=np.int64)
    if len(full):
        size[full + 1] = np.add.reduceat(keep, offs[full], dtype=np.int64)
    return np.append(_NORMAL[data[keep]], np.zeros(8, dtype=np.uint8)), np.cumsum(size), keep


def gram_prints(four: np.ndarray) -> np.ndarray:
    return ((four.astype(np.uint64) * _ODD) >> np.uint64(40)).astype(np.int64) % PRINT


def nearest(item: bytes, text: bytes) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any part of ``text``, and where that ends."""
    m, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diag = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~((diag | minus) | up))
        minus = up & (diag | minus)
        if score < best:
            best, end = score, j + 1
    return best, end


def runs(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``count[i]`` numbers from ``first[i]`` on, for all i in order."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Index:
    """The items of one block: texts, their pieces by length, prints of their grams."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        items = [(i, b" ".join((t or "").encode().translate(LOWER.tobytes()).split())) for i, t in rows]
        items = [(i, t) for i, t in items if t.count(b" ") >= LEAST_WORDS - 1 or len(t) >= LEAST_BYTES]
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.size = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.edits = (RATIO * self.size).astype(np.int64)
        flat = np.frombuffer(b"".join(self.texts) + bytes(8), dtype=np.uint8)
        begin = np.cumsum(self.size) - self.size
        grams = np.maximum(self.size - GRAM + 1, 0)
        self.starts = np.append(0, np.cumsum(grams))
        self.flat = gram_prints(words_at(flat, "<u4")[runs(grams, begin)])
        # Piece j of an item goes from byte size * j // (edits + 1) on.
        pieces = self.edits + 1
        item, j = np.repeat(np.arange(len(items)), pieces), runs(pieces, np.zeros(len(items), dtype=np.int64))
        place, end = self.size[item] * j // pieces[item], self.size[item] * (j + 1) // pieces[item]
        length, eight = end - place, words_at(flat, "<u8")
        self.seeds = []  # per length of head: mask, filter's shift and filter, heads, tails, lengths, items, places
        for n in np.unique(np.minimum(length, 8)).tolist():
            mine, mask = np.flatnonzero(np.minimum(length, 8) == n), np.uint64((1 << 8 * n) - 1)
            at = begin[item[mine]]
            head, tail = eight[at + place[mine]] & mask, eight[at + end[mine] - n] & mask
            order = np.argsort(head, kind="stable")
            mine, head, tail = mine[order], head[order], tail[order]
            bits = min(26, max(16, (16 * len(mine)).bit_length()))
            seen = np.zeros(1 << bits, dtype=bool)
            seen[(head * _ODD) >> np.uint64(64 - bits)] = True
            self.seeds.append((mask, np.uint64(64 - bits), seen, head, tail, length[mine], item[mine], place[mine]))

    def windows(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first byte, end) around each piece that is in ``data``."""
        eight, found = words_at(data, "<u8"), []
        for at in range(0, len(eight), PIECE):
            here = np.ascontiguousarray(eight[at:at + PIECE])
            for mask, shift, seen, head, tail, length, item, place in self.seeds:
                some = here & mask
                hit = np.flatnonzero(seen[(some * _ODD) >> shift])
                lo = np.searchsorted(head, some[hit], "left")
                many = np.searchsorted(head, some[hit], "right") - lo
                which = np.repeat(np.arange(len(hit)), many)
                p = np.repeat(lo, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
                begin = hit[which] + at
                last = np.minimum(begin + np.maximum(length[p] - 8, 0), len(eight) - 1)
                good = (eight[last] & mask) == tail[p]
                begin, p = begin[good], p[good]
                doc = np.searchsorted(offs, begin, "right") - 1
                e = self.edits[item[p]]
                bucket = (begin - offs[doc] - place[p]) // (e + 1)  # nearby places share a window
                found.append(np.stack([doc, item[p], bucket]))
        if not found:
            return (np.zeros(0, dtype=np.int64),) * 4
        doc, item, bucket = np.unique(np.concatenate(found, axis=1), axis=1)
        e, size = self.edits[item], self.size[item]
        first = offs[doc] + bucket * (e + 1) - e
        end = np.minimum(first + size + 3 * e, offs[doc + 1])
        return doc, item, np.maximum(first, offs[doc]), end

    def likely(self, data: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the windows that hold enough of their item's grams."""
        four, out = words_at(data, "<u4"), []
        for lot in range(0, len(item), LOT):
            k, a = item[lot:lot + LOT], first[lot:lot + LOT]
            n = end[lot:lot + LOT] - a
            row = np.arange(len(k)) * PRINT
            marks = np.zeros(len(k) * PRINT, dtype=bool)
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            marks[gram_prints(four[at]) + np.repeat(row, n)] = True
            n = self.starts[k + 1] - self.starts[k]
            ends = np.cumsum(n)
            at = np.repeat(self.starts[k] - (ends - n), n) + np.arange(int(ends[-1]))
            shared = np.add.reduceat(marks[self.flat[at] + np.repeat(row, n)], ends - n, dtype=np.int64)
            out.append(lot + np.flatnonzero(shared >= n - GRAM * self.edits[k]))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, edit distance, place of the window in the text)."""
        known: dict[tuple[int, bytes], int] = {}
        for base, _, raw, offs in blocks(column, PIECE):
            if not len(raw):
                continue
            data, ends, keep = squeezed(raw, offs)
            doc, item, first, end = self.windows(data, ends)
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for i in self.likely(data, item, first, end).tolist():
                d, k, a = int(doc[i]), int(item[i]), int(first[i])
                wide = data[a:end[i]].tobytes()
                got = known.get((k, wide))
                if got is None:
                    if len(known) > 50_000:
                        known.clear()
                    got = known[k, wide] = nearest(self.texts[k], wide)[0]
                if got <= self.edits[k]:
                    best[d, k] = min(best.get((d, k), (len(self.texts[k]), 0)), (got, a - int(ends[d])))
            for (d, k), (edits, place) in sorted(best.items()):
                yield base + d, k, edits, int(np.flatnonzero(keep[offs[d]:offs[d + 1]])[place])


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Index]:
    """Indexes over ``items`` (item_id, text), each of a checked size."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text").cast("bigint") + 16).alias("b")).first()["b"] or 0
    parts = -(-size // limit)
    for p in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p) if parts > 1 else items
        yield Index(sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0)))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, edit_distance, item_bytes, start_byte: one row per leaked item and document."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, edit_distance bigint, item_bytes bigint, start_byte bigint"
    for index in item_blocks(items):

        @tidy
        def scan(batches, index=index):
            for b in batches:
                ids, found = b.column(0), list(index.leaks(b.column(1)))
                cols = [ids.take(pa.array([f[0] for f in found], pa.int64()))]
                cols += [pa.array(x, pa.int64()) for x in (
                    [index.ids[f[1]] for f in found], [f[2] for f in found],
                    [len(index.texts[f[1]]) for f in found], [f[3] for f in found])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "edit_distance", "item_bytes", "start_byte"])

        part = rows.mapInArrow(scan, schema)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], schema) if out is None else out


@keeps_names
def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with a column text) that hold no item."""
    place = docs.columns.index("text")
    for index in item_blocks(items):

        @tidy
        def keep(batches, index=index):
            for b in batches:
                clean = np.ones(b.num_rows, dtype=bool)
                clean[[f[0] for f in index.leaks(b.column(place))]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
