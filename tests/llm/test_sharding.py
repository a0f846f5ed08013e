import zlib
from collections import Counter

import numpy as np
from kinlink.llm import sharding


def check(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_shards_are_exact(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op2_uniform_shards(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    check(rows, 40)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.op2_uniform_shards(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_odd_rows(odd, none):
    rows = sharding.shard(odd, shards=3).collect()
    assert len(rows) == odd.count()
    check(rows, 3)
    assert sharding.shard(none).count() == 0


def test_shuffle_is_uniform(spark):
    # Every row is equally likely in every shard: chi-squared over seeds.
    df = spark.range(6).selectExpr("id AS doc_id", "'t' AS text")
    seen = np.zeros((6, 3))
    for seed in range(60):
        for r in sharding.shard(df, shards=3, partitions=2, cells=1, seed=seed).collect():
            seen[r["doc_id"], r["shard"]] += 1
    assert ((seen - 20) ** 2 / 20).sum() < 40


def test_matrix_margins_and_large_populations():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 30).tolist()
    sizes = sharding.shard_sizes(sum(counts), 7)
    m = sharding.communication_matrix(counts, sizes)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and (m >= 0).all()
    big = [4 * 10**9, 3 * 10**9, 10**9]
    m = sharding.communication_matrix(big, sharding.shard_sizes(sum(big), 4))
    assert m.sum(axis=1).tolist() == big and m.sum(axis=0).tolist() == [2 * 10**9] * 4
    draws = [sharding.hypergeometric(rng, 10**9, 10**9, 10**6) for _ in range(400)]
    assert abs(np.mean(draws) - 5e5) < 4 * 500 / 20 and 350 < np.std(draws) < 650


def test_layout_grows_with_the_table():
    assert sharding.layout(0, 40) == (1024, 8) == sharding.layout(10**6, 40)
    for rows in (10**8, 10**9, 4 * 10**9, 10**11):
        p, c = sharding.layout(rows, 40)
        assert p * c * 40 <= sharding.MATRIX and p >= 1024 and c >= 8
        if rows <= 4 * 10**9:
            assert rows <= 2 * p * sharding.TASK_ROWS and rows <= 2 * c * 40 * sharding.TASK_ROWS


def test_rows_without_an_id_spread(spark):
    from pyspark.sql import functions as F

    df = spark.range(400).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("x").alias("__p"), F.lit(1).alias("__cell"))
    got = sharding.shard(df, shards=4)
    assert {"__p", "__cell"} <= set(got.columns)
    rows = got.collect()
    check(rows, 4)
    runs = [r["text"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert runs != sorted(runs) and {r["__p"] for r in rows} == {"x"}


def plain(rows, shards, seed):
    """(doc_id, text) -> [(doc_id, crc, shard, slot)], step by step in Python."""
    import struct

    import xxhash

    def digest(*values):
        h = 42
        for v in values:
            if v is not None:
                raw = v.encode() if isinstance(v, str) else struct.pack("<q" if isinstance(v, Long) else "<i", v)
                h = xxhash.xxh64(raw, seed=h).intdigest()
        return h - (1 << 64) if h >> 63 else h

    class Long(int):
        pass

    long = lambda v: None if v is None else Long(v)
    partitions, cells = sharding.layout(len(rows), shards)
    parts = [[] for _ in range(partitions)]
    for i, t in rows:
        parts[digest(seed, long(i), t) % partitions].append((i, zlib.crc32((t or "").encode())))
    sizes = [c for n in sharding.shard_sizes(len(rows), shards) for c in sharding.shard_sizes(n, cells)]
    matrix, held = sharding.communication_matrix([len(p) for p in parts], sizes, seed), [[] for _ in sizes]
    order = lambda s: lambda r: (digest(s, long(r[0]), long(r[1])), r[0] is not None, r[0] or 0, r[1])
    for p, counts in zip(parts, matrix.tolist()):
        p.sort(key=order(seed + 1))
        for cell, n in enumerate(counts):
            held[cell] += p[:n]
            del p[:n]
    out = []
    for s in range(shards):
        own = [r for c in range(s * cells, (s + 1) * cells) for r in sorted(held[c], key=order(seed + 2))]
        out += [(*r, s, k) for k, r in enumerate(own)]
    return out


def test_equals_a_plain_version(spark, odd, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df, shards in ((docs, 40), (odd.select("doc_id", "text"), 3)):
        want = plain([tuple(r) for r in df.collect()], shards, sharding.SEED)
        got = [(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df, shards).collect()]
        assert sorted(got, key=lambda r: (r[2], r[3])) == sorted(want, key=lambda r: (r[2], r[3])) and len(got) == len({(r[2], r[3]) for r in got})
