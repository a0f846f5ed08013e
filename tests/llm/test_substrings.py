import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinlink.llm import cdc, suffixes
from kinlink.llm.spans import Chunk


def outcome(text, removed):
    kept = bytes(b for b, r in zip(text, removed) if not r)
    runs = sum(1 for i, r in enumerate(removed) if r and (i == 0 or not removed[i - 1]))
    return len(text), sum(removed), runs, hashlib.sha256(kept).hexdigest()


def by_suffixes(docs):
    """(id, bytes) in ascending id -> result rows, straight from the definition."""
    first, out = {}, []
    for i, t in docs:
        for k in range(len(t) - 49):
            first[t[k:k + 50]] = min(first.get(t[k:k + 50], i), i)
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        out.append((i, *outcome(t, gone)))
    return out


def by_chunks(docs):
    first, out = {}, []
    for i, t in docs:
        gone, at = bytearray(len(t)), 0
        for end in cdc.cut_points(t):
            if end - at >= cdc.LEAST and first.setdefault(t[at:end], (i, at)) != (i, at):
                gone[at:end] = b"\1" * (end - at)
            at = end
        out.append((i, *outcome(t, gone)))
    return out


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("run, brute", [(suffixes.op3_suffix_array_dedup, by_suffixes), (cdc.op9_content_chunks, by_chunks)])
def test_equals_brute_force(spark, sf_dir, run, brute):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert table(run(spark, sf_dir)) == sorted(brute(docs))


@pytest.mark.parametrize("run, brute", [(suffixes.dedup_suffixes, by_suffixes), (cdc.dedup_chunks, by_chunks)])
def test_odd_rows(odd, none, run, brute):
    got = run(odd).collect()
    assert len(got) == odd.count() and run(none).count() == 0
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect())
    assert sorted({tuple(r) for r in got if r["doc_id"] is not None}) == sorted(brute(rows))
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)


def test_overlaps_buckets_and_levels(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abc d") for _ in range(rng.randrange(30, 90))) for _ in range(25)]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    monkeypatch.setattr(suffixes, "BATCH", 64)
    got = table(suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), suffixes._emit, suffixes._settle, 3.5, 4000))
    assert got == sorted(by_suffixes([(i, t.encode()) for i, t in docs]))


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 200)
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 101) for _ in range(1500))
    cover = [0] * 1500
    for _, _, start, lo, hi, _ in suffixes.contexts(Chunk([(1, 0, text)])):
        for s, n in zip(start, hi - lo):
            for k in range(s, s + n - 49):
                cover[k] += 1
    assert cover == [1] * 1451 + [0] * 49


def test_frequent_anchors_are_passed_over(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffixes, "BUCKET", 3000)
    rng = random.Random(11)
    # A gram in the middle of ever new text, whose hash would win most windows.
    grams = [bytes(rng.randrange(97, 123) for _ in range(8)) for _ in range(3000)]
    low = np.array([suffixes.anchors(np.frombuffer(g + b"x" * 42, dtype=np.uint8))[1][0] for g in grams])
    often = grams[int(low.argmin())]
    docs = []
    for i in range(150):
        word = lambda: bytes(rng.randrange(97, 123) for _ in range(22))
        t = b"".join(word() + often for _ in range(12))
        docs.append((i, t + (docs[i - 1][1][:120] if i % 5 == 4 else b"")))
    df = spark.createDataFrame([(i, t.decode()) for i, t in docs], "doc_id bigint, text string")
    assert table(suffixes.dedup_suffixes(df)) == sorted(by_suffixes(docs))
    chunk = Chunk([(i, 0, t) for i, t in docs])
    weigh = lambda heavy: np.bincount(np.concatenate([g % np.uint64(1 << 16) for *_, g in suffixes.contexts(chunk, heavy)]).astype(np.int64), minlength=1 << 16)
    before = weigh(None)
    heavy = before > 50
    after = weigh(heavy)
    assert before.max() > 1000 and after.max() < before.max() / 20


def test_log_index_levels_double():
    import numpy as np

    index = suffixes.LogIndex()
    for d in range(8):
        keys = np.array([b"%050d" % k for k in range(d * 3, d * 3 + 4)], dtype="S50")
        hit = index.insert(keys, np.full(4, d))
        assert hit.tolist() == [d > 0, False, False, False]
    assert [x is not None for x in index.levels] == [False, False, False, True]


def test_chunks_resist_insertions():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(4000))
    split = lambda t: [t[a:b] for a, b in zip([0, *cdc.cut_points(t)], cdc.cut_points(t))]
    before, after = split(text), split(text[:2000] + b"NEW" + text[2000:])
    assert len(set(before) - set(after)) <= 4
    assert all(len(c) >= cdc.LEAST for c in before[:-1]) and max(map(len, before)) <= cdc.MOST


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_cut_points_cover(text):
    ends = cdc.cut_points(text)
    assert ends == sorted(set(ends)) and (ends[-1] == len(text) if text else ends == [])
