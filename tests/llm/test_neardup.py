import random
import re
from collections import Counter, defaultdict

from kinlink.llm import components, neardup
from kinlink.llm.words import LOWER

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall((text or "").encode().translate(LOWER.tobytes()))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """{id: text} -> {id: (shingles, component)}."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i in sorted(docs):
        common = Counter(j for s in sets[i] for j in seen[s])
        for s in sets[i]:
            seen[s].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in docs}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert result(neardup.op8_minhash_neardup(spark, sf_dir)) == brute(docs)


def test_copies_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 16)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, base = {}, [word() for _ in range(150)]
    for i in range(80):  # one large group of near copies
        t = list(base)
        t[rng.randrange(150)] = word()
        docs[i] = " ".join(t)
    chain = [word() for _ in range(120)]
    for i in range(100, 130):  # neighbours are near, ends are not
        docs[i] = " ".join(chain)
        chain[4 * (i - 100):4 * (i - 100) + 3] = [word() for _ in range(3)]
    for i in range(200, 230):  # exact copies but for case and spaces
        docs[i] = "  Same   TEXT here with more than five words \n"[i % 2:]
    half = [word() for _ in range(60)]
    for i in range(300, 340):  # half in common: no links
        docs[i] = " ".join(half + [word() for _ in range(60)])
    got = result(neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(4)))
    assert got == brute(docs)


def test_odd_rows(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and neardup.near_duplicates(none).count() == 0
    want = brute({r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None})
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
        else:
            assert r["kept"] and r["component_id"] is None
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_every_pair_under_the_signature_distance_shares_a_key():
    rng = random.Random(4)
    for _ in range(300):
        wrong = set(rng.sample(range(neardup.SYMBOLS), 2 * neardup.CHUNKS - 1))
        assert any(sum(c * neardup.WIDTH + i in wrong for i in range(neardup.WIDTH)) <= 1 for c in range(neardup.CHUNKS))


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
