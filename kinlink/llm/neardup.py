"""Near-duplicates: b-bit minhash signatures and a multi-index Hamming join.

1. Every text gets its set of word shingles (64-bit hashes), a digest of that set
   and a signature of ``CHUNKS * WIDTH`` minhashes of 16 bits.  Texts with equal
   sets form a class and go on as one representative.
2. Signatures are split into chunks.  Two signatures that differ in at most
   2 * CHUNKS - 1 symbols have a chunk with at most one error (pigeonhole), so
   each chunk is indexed once for each symbol that may be wrong: all pairs under
   that distance share a key, surely.  Pairs above it are found with probability
   1 - (1 - p)^CHUNKS, p = j^5 + 5 (1 - j) j^4: 0.9998 at similarity j = 0.75.
3. First round: every member of a key's bucket meets the bucket's smallest
   member.  Pairs whose longer sketches differ in at most ``NEAR`` places are
   confirmed on full sets; confirmed links give components.
4. Second round: in buckets that still hold several components all pairs across
   components are compared by sketch; a bucket hands on a spanning forest of the
   near ones, and the forests join to groups that hold every near pair.  A group
   gets each member's full set once, confirms all near pairs across components
   and hands on one link per two components.  So no link between different texts
   is lost, yet a group never makes rows for its pairs.  Buckets and groups above
   ``SPLIT`` rows (or their sets' bytes) are dealt to pairs of blocks: a task holds two
   blocks at most.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing; a null doc_id is linked with nothing, its component is null and it is
kept; rows of one doc_id and equal text are one node; an empty table gives an
empty result; further columns are ignored by ``near_duplicates`` and kept by
``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.components import components
from kinlink.llm.scratch import cut, keeps_names, tables
from kinlink.llm.words import LOWER, blocks, give_back, mix, shingles, tidy, word_hashes

WORDS, CHUNKS, WIDTH = 5, 9, 5
SYMBOLS = CHUNKS * WIDTH
#: A longer sketch of LONG minhashes of 8 bits tells which candidates are confirmed
#: on sets: those that differ in at most NEAR places.  Similarity 0.75 gives 32 on
#: average with deviation 4.9, so one in 30,000 such pairs is further off.
LONG, NEAR = 128, 52
PERCENT = 75
#: Rows of a block, each counted once for every SET_BYTES of its set.
SPLIT, SET_BYTES = 2048, 16 << 10
#: Bits of the filter that keeps texts out of an exchange; its size is fixed.
FILTER_BITS = 1 << 25

_FACTORS = mix(np.arange(101, 101 + LONG, dtype=np.uint64)) | np.uint64(1)


def shingle_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes in order, their number per row) for runs of rows."""
    for lo, _, data, offs in blocks(column):
        words, counts = word_hashes(LOWER[data], offs)
        yield lo, *shingles(words, counts, WORDS)


def signature(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit minhash symbols and the longer sketch, one row per text; 0 without shingles."""
    out, sketch = np.zeros((len(n), SYMBOLS), dtype=np.int32), np.zeros((len(n), LONG), dtype=np.uint8)
    full = np.flatnonzero(n)
    if len(full):
        at = (np.cumsum(n) - n)[full]
        for j, a in enumerate(_FACTORS):
            low = np.minimum.reduceat(((values * a) >> np.uint64(32)).astype(np.uint32), at)
            sketch[full, j] = low.astype(np.uint8)
            if j < SYMBOLS:
                out[full, j] = (low & np.uint32(0xFFFF)).astype(np.int32)
    return out, sketch


@tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, values, n in shingle_blocks(b.column(1)):
            sizes, digests, at = np.zeros(len(n), dtype=np.int64), [], 0
            for i, c in enumerate(n.tolist()):
                own = np.unique(values[at:at + c])
                at += c
                sizes[i] = len(own)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            sig, sketch = signature(values, n)
            offs = pa.array(np.arange(0, sig.size + 1, SYMBOLS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, len(n)), pa.array(sizes), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(offs, pa.array(sig.ravel())),
                 pa.array([r.tobytes() for r in sketch], pa.binary())],
                ["doc_id", "n_shingles", "digest", "sig", "sketch"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, values, n in shingle_blocks(b.column(1)):
            own, at = [], 0
            for c in n.tolist():
                own.append(np.unique(values[at:at + c]).tobytes())
                at += c
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(n)), pa.array(own, pa.binary())], ["sid", "own"])


@tidy
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column(2), b.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            short, long = (x, y) if len(x) <= len(y) else (y, x)
            if 100 * len(short) < PERCENT * len(long):
                good.append(False)
                continue
            at = np.searchsorted(long, short)
            same = int((long[np.minimum(at, len(long) - 1)] == short).sum())
            good.append(100 * same >= PERCENT * (len(x) + len(y) - same))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good, pa.bool_()))


def sub_keys():
    """All keys of a signature: chunk and left-out position with the other symbols."""
    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            rest = [F.get("sig", F.lit(c * WIDTH + i)) for i in range(WIDTH) if i != out]
            keys.append(F.xxhash64(F.lit(c * WIDTH + out), *rest))
    return F.array(*keys)


def sketches(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, LONG)


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = (sketches(b.column(2)) != sketches(b.column(3))).sum(axis=1) <= NEAR
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(good))


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``.

    A bitmap of FILTER_BITS hashed ids goes to all tasks first (4 MB at most,
    whatever the tables hold); only rows that pass it are exchanged and joined.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    maps = (ids.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__map")))
    at = F.bitmap_bit_position(F.col("__s"))
    byte = F.conv(F.hex(F.substring("__map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    some = (docs.withColumn("__s", slot).join(F.broadcast(maps), F.bitmap_bucket_number("__s") == F.col("__b"))
            .filter(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__s", "__b", "__map"))
    return some.join(ids.hint("merge"), "doc_id", "left_semi")


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the left and of the right block of a task, and whether these are one."""
    block, left, right = rows["block"].to_numpy(), rows["left"][0].as_py(), rows["right"][0].as_py()
    return np.flatnonzero(block == left), np.flatnonzero(block == right), left == right


def _near_pairs(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers: one of the left block and all near it of other components."""
    comp, sketch = rows["comp"].to_numpy(), sketches(rows["sketch"])
    ours, theirs, same = _sides(rows)
    for k, i in enumerate(ours):
        to = theirs[k + 1:] if same else theirs
        to = to[comp[to] != comp[i]]
        if len(to):
            yield i, to[(sketch[to] != sketch[i]).sum(axis=1) <= NEAR]


class Forest:
    """Which nodes are connected; ``join`` tells the labels that a node newly meets."""

    def __init__(self, labels: np.ndarray):
        self.label = labels.copy()

    def join(self, i: int, to: np.ndarray) -> list[int]:
        met = []
        for x in np.unique(self.label[to]).tolist():
            if x != self.label[i]:
                met.append(int(to[self.label[to] == x][0]))
                self.label[self.label == x] = self.label[i]
        return met


def _edges(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    e = np.array([(ids[i], ids[j]) for i, j in pairs], dtype=np.int64).reshape(-1, 2)
    return pa.table({"u": e.min(axis=1), "v": e.max(axis=1)}) if len(e) else pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})


def _chains(rows: pa.Table) -> pa.Table:
    """A spanning forest of a bucket's pairs that are near and not connected yet."""
    ids, out = rows["id"].to_numpy(), []
    forest = Forest(np.arange(len(ids)))
    for i, to in _near_pairs(rows):
        out += [(i, j) for j in forest.join(i, to)]
    if len(ids) > 256:
        give_back()
    return _edges(ids, out)


def overlaps(sets: list[np.ndarray], ours: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Sizes of all intersections, exactly, by products of 0/1 blocks of columns."""
    sizes = np.array([len(s) for s in sets])
    token, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), sizes), times[number] > 1
    column = (np.cumsum(times > 1) - 1)[number[shared]]
    row, out = row[shared], np.zeros((len(ours), len(theirs)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        out += part[ours] @ part[theirs].T
    return out.astype(np.int64)


def _links(rows: pa.Table) -> pa.Table:
    """Confirmed links between components, one for each pair of components at most."""
    ids, comp = rows["id"].to_numpy(), rows["comp"].to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["own"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    ours, theirs, _ = _sides(rows)
    common, at, out = overlaps(sets, ours, theirs), {int(i): k for k, i in enumerate(ours)}, []
    place = np.zeros(len(ids), dtype=np.int64)
    place[theirs] = np.arange(len(theirs))
    forest = Forest(comp)
    for i, to in _near_pairs(rows):
        n = common[at[int(i)], place[to]]
        out += [(i, j) for j in forest.join(i, to[100 * n >= PERCENT * (sizes[i] + sizes[to] - n)])]
    del common, sets
    if len(ids) > 256:
        give_back()
    return _edges(ids, out)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(sid, own): the sorted shingle hashes of the documents in ``ids`` (doc_id)."""
    return only_ids(docs.select("doc_id", "text"), ids).mapInArrow(_sets, "sid bigint, own binary")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of doc_ids whose full sets are similar enough."""
    sets = cut(shingle_sets(docs, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()))
    return (pairs.join(sets.select(F.col("sid").alias("u"), F.col("own").alias("a")).hint("merge"), "u")
            .join(sets.select(F.col("sid").alias("v"), F.col("own").alias("b")).hint("merge"), "v")
            .select("u", "v", "a", "b").mapInArrow(_confirm, "u bigint, v bigint"))


def by_blocks(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a group with ``size`` rows, dealt to all pairs of its blocks."""
    n = F.ceil(F.col("size") / SPLIT).cast("int")
    return (rows.withColumn("block", F.pmod(F.xxhash64("id"), n).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
            .withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other", "size")
            .groupBy(key, "left", "right"))


def describe(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")\
        .mapInArrow(_describe, "doc_id bigint, n_shingles bigint, digest binary, sig array<int>, sketch binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    all_rows = cut(describe(docs))
    classes = cut(all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
                  .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n")))
    # Joins by merging throughout: what is small enough to broadcast only costs the driver memory.
    reps = classes.filter("n > 1").select(F.col("rep").alias("id"), "sketch").hint("merge")
    keys = classes.filter("n > 1").select(F.col("rep").alias("id"), "sig").select("id", F.explode(sub_keys()).alias("key"))
    buckets = cut(keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = cut(keys.join(buckets.hint("merge"), "key"))
    pairs = members.filter("id <> leader").select(F.col("leader").alias("u"), F.col("id").alias("v")).distinct()
    near = cut(pairs.join(reps.select(F.col("id").alias("u"), F.col("sketch").alias("x")).hint("merge"), "u")
               .join(reps.select(F.col("id").alias("v"), F.col("sketch").alias("y")).hint("merge"), "v")
               .select("u", "v", "x", "y").mapInArrow(_near, "u bigint, v bigint"))
    links = cut(confirmed(docs, near))
    comp = cut(components(links))
    named = cut(members.filter("size > 2").join(comp.hint("merge"), "id", "left")
                .select("key", "id", "size", F.coalesce("root", "id").alias("comp")))
    mixed = named.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("key")
    rows = named.join(mixed.hint("merge"), "key", "left_semi").join(reps, "id").select("key", "size", "id", "comp", "sketch")
    chains = cut(by_blocks(rows, "key").applyInArrow(_chains, "u bigint, v bigint").distinct())
    final = comp
    if chains.take(1):
        group = cut(components(chains).select("id", F.col("root").alias("group")))
        own = shingle_sets(docs, group.select(F.col("id").alias("doc_id"))).withColumnRenamed("sid", "id")
        held = cut(group.join(own.hint("merge"), "id"))
        weight = F.ceil(F.octet_length("own") / SET_BYTES)
        sizes = held.groupBy("group").agg(F.sum(weight).alias("size"))
        full = (held.join(sizes.hint("merge"), "group").join(reps, "id").join(comp.hint("merge"), "id", "left")
                .select("group", "size", "id", F.coalesce("root", "id").alias("comp"), "sketch", "own"))
        final = cut(components(links.union(by_blocks(full, "group").applyInArrow(_links, "u bigint, v bigint"))))
    owner = classes.join(final.hint("merge"), F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("root", "rep").alias("__root"))
    found = F.coalesce("__root", "doc_id")
    lone = all_rows.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("__root"))
    return (all_rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(owner.hint("merge"), "digest", "left").select("doc_id", "n_shingles", "__root").union(lone)
            .select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept")))


@keeps_names
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with one document of each group."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    first = (docs.join(kept.hint("merge"), "doc_id", "left_semi").withColumn("__text", F.xxhash64("text"))
             .withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy("__text"))).filter("__n = 1").drop("__n", "__text"))
    return first.unionByName(docs.filter("doc_id IS NULL"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(tables(spark, sf_dir, "documents"))
