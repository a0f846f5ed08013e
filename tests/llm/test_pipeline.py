import re
import zlib
from collections import Counter

import corpus_pipeline as p
from test_neardup import brute


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = p.run(spark, sf_dir).collect()
    # Language: documents with letters in a known language stay.
    left = {i: r for i, r in docs.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    got = {r["doc_id"] for r in p.language(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()}
    assert got == set(left)
    # Near duplicates: the smallest of each component stays.
    comp = brute({i: r["text"] for i, r in left.items()})
    left = {i: r for i, r in left.items() if comp[i][1] == i}
    # Benchmark passages: exact ones surely go.
    squeeze = lambda t: " ".join((t or "").lower().split())
    items = [squeeze(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i: r for i, r in left.items() if not any(x in squeeze(r["text"]) for x in items)}
    # Mixing: sources come near their targets; sharding: sizes one apart, slots gapless.
    assert {r["doc_id"] for r in rows} <= set(left)
    copies = Counter(r["doc_id"] for r in rows)
    assert max(copies.values()) <= 3
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r["text"]) for r in left.values())
    assert abs(sum(words(r["text"]) for r in rows) - total) < 0.1 * total
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
    for r in rows:
        assert r["text"] == docs[r["doc_id"]]["text"] and r["text_crc32"] == zlib.crc32(r["text"].encode())
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))


def test_stages_keep_the_columns_and_survive_odd_rows(spark, odd, none, sf_dir):
    for name, stage in p.STAGES:
        out = stage(spark, odd, sf_dir)
        if name != "sharding":
            assert out.columns == odd.columns, name
        assert out.count() >= 0
        assert stage(spark, none, sf_dir).count() == 0
    assert len(p.STAGES) == 5


def test_odd_names_keep_their_values(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = {"__text": F.lit("a"), "__n": F.lit(1), "__s": F.lit("b"), "__score": F.lit(2), "__row": F.lit("c"), "a`b": F.lit(3), "taken": F.lit("d"), "__skey": F.lit(4)}
    docs = docs.withColumns(more)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        row = out.first()
        assert [row[c] for c in more] == ["a", 1, "b", 2, "c", 3, "d", 4], name
