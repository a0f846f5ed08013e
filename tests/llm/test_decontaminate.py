import random

from kinlink.llm import decontaminate as d


def plain(a, b):
    """Smallest edit distance of a to any part of b, by the full table."""
    row = list(range(len(a) + 1))
    best = row[-1]
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(200):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        assert d.nearest(a, b)[0] == plain(a, b)


def test_finds_all_exact_passages_and_nothing_else(spark, sf_dir):
    squeeze = lambda t: " ".join((t or "").lower().split())
    docs = [(r["doc_id"], squeeze(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], squeeze(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in d.op10_decontaminate(spark, sf_dir).collect()}
    exact = {(i, k) for i, t in docs for k, x in items if x in t}
    assert exact and {p for p, e in got.items() if e == 0} == exact
    text, item = dict(docs), dict(items)
    for (i, k), e in got.items():
        assert e <= d.RATIO * len(item[k].encode()) and plain(item[k].encode(), text[i].encode()) <= e


def test_recall_of_edited_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(25, 60)))) for k in range(40)]
    docs, want = [], set()
    for i in range(240):
        body = [word() for _ in range(200)]
        if i % 2:
            k, t = items[i % 40]
            t = list(t)
            for _ in range(int(len(t) * rng.uniform(0, 0.07))):
                at = rng.randrange(len(t))
                t[at:at + rng.randrange(2)] = rng.choice(["", "z", "q"])
            if plain(items[k][1].encode(), "".join(t).encode()) <= d.RATIO * len(items[k][1]):
                want.add((i, k))
            body[90:90] = "".join(t).split()
        docs.append((i, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(df, bench).collect()}
    assert len(want) > 80 and len(want & got) >= 0.97 * len(want) and {i for i, _ in got} <= {i for i, _ in want}
    clean = {r["doc_id"] for r in d.without_leaks(df, bench).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in got}


def test_benchmark_in_blocks(spark, sf_dir, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert len(list(d.item_blocks(items, 2000))) > 3
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(d.find_leaks(docs, items).collect())
    monkeypatch.setattr(d.item_blocks, "__defaults__", (2000,))
    assert sorted(d.find_leaks(docs, items).collect()) == want


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "la mer, où êtes-vous?"), (None, "la mer, où êtes-vous?")], "item_id bigint, text string")
    got = d.find_leaks(odd, bench).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == [(12, 0), (12, 0), (12, 4), (12, 4)]
    assert d.without_leaks(odd, bench).count() == odd.count() - 2
    assert d.find_leaks(none, bench).count() == 0 and d.find_leaks(odd, bench.limit(0)).count() == 0
    assert d.without_leaks(odd, bench.limit(0)).count() == odd.count()


def test_finds_edits_spread_evenly(spark):
    """One letter in every third word: no three words in a row stay, all within RATIO."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(5, 60)))) for k in range(60)]
    docs = []
    for k, t in items:
        words = t.split()
        for at in range(2, len(words), 3):
            words[at] = words[at][:1] + "z" + words[at][2:]
        assert plain(t.encode(), " ".join(words).encode()) <= d.RATIO * len(t)
        docs.append((k, " ".join([*(word() for _ in range(40)), *words, *(word() for _ in range(40))])))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(df, bench).collect()}
    assert got == {(k, k) for k, _ in items}
    assert d.without_leaks(df, bench).count() == 0


def test_equals_brute_force_up_to_the_bound():
    import pyarrow as pa

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 25)))) for k in range(40)]
    texts = []
    for _ in range(120):
        t = list(rng.choice(items)[1])
        for _ in range(int(len(t) * rng.uniform(0, 0.13))):
            at = rng.randrange(len(t))
            t[at:at + rng.randrange(2)] = rng.choice(["", "a", " ", "d"])
        texts.append("".join([" ".join(word() for _ in range(15)), rng.choice([" ", " \n\t"]), "".join(t), " ", word()]))
    index = d.Index(items)
    got = {(row, item): edits for row, item, edits, _ in index.leaks(pa.array(texts))}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(index.texts):
            edits = plain(item, " ".join(t.split()).encode())
            if edits <= d.RATIO * len(item):
                want[i, k] = edits
    assert len(want) > 60 and got == want


def test_finds_inserted_words_in_long_items():
    """8 % of the bytes come in as short words, far more than two."""
    import pyarrow as pa

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    items = [(k, " ".join(word() for _ in range(rng.randrange(40, 120)))) for k in range(30)]
    texts = []
    for k, t in items:
        words, more = t.split(), int(0.08 * len(t)) // 2
        words[len(words) // 2:len(words) // 2] = [rng.choice("qxyz") for _ in range(more)]
        assert more > 5 and plain(t.encode(), " ".join(words).encode()) <= d.RATIO * len(t)
        texts.append(" ".join([*(word() for _ in range(30)), *words, *(word() for _ in range(30))]))
    got = {(row, item) for row, item, _, _ in d.Index(items).leaks(pa.array(texts))}
    assert got == {(k, k) for k, _ in items}


def test_scripts_without_spaces():
    import pyarrow as pa

    item = "\u6c34\u66dc\u65e5\u306b\u5e02\u5834\u3078\u884c\u304f"
    index = d.Index([(1, item), (2, "\u6c34\u66dc"), (3, "one two"), (4, None), (5, "a b c")])
    assert index.ids == [1, 5]
    texts = ["\u6628" * 20 + item + "\u6628" * 20, item, "one two", "\u6c34\u66dc", None, "say a b c"]
    assert sorted((r, k) for r, k, _, _ in index.leaks(pa.array(texts))) == [(0, 0), (1, 0), (5, 1)]


def test_seeds_are_the_pieces_of_the_items():
    rng = random.Random(2)
    items = [(k, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(3, 60)))) for k in range(50)]
    index, want = d.Index(items), []
    for k, (_, t) in enumerate(items):
        t, e = t.encode(), int(d.RATIO * len(t))
        for j in range(e + 1):
            a, b = len(t) * j // (e + 1), len(t) * (j + 1) // (e + 1)
            want.append((t[a:min(b, a + 8)], t[max(a, b - 8):b], b - a, k, a))
    got = []
    for mask, _, _, head, tail, length, item, place in index.seeds:
        n = int(mask).bit_length() // 8
        got += [(int(h).to_bytes(n, "little"), int(x).to_bytes(n, "little"), m, k, a) for h, x, m, k, a in zip(head.tolist(), tail.tolist(), length.tolist(), item.tolist(), place.tolist())]
    assert sorted(got) == sorted(want)
