import random

import pytest
from kinlink.operators import fold
from kinlink.plans import engine as e
from kinlink.plans.config import FieldSpec, LinkageConfig
from kinlink.plans.engine import LinkageEngine, score_table
from kinlink.plans.precision import Precision
from kinlink.sources.synth import RandomInput, bench_config, person_config
from plain import frames, link, pair, rows
from pyspark.sql import functions as F

MODES = ("int16", "int32", "int64", "exact")


def close(got, want, mode):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    if mode == "exact":
        assert [x for g in got for x in g[3:]] == pytest.approx([x for w in want for x in w[3:]])
    else:
        assert got == want


def fixture(kind):
    integer = lambda n: FieldSpec(n, 0.5, 0.0, "binary", "integer", 29)
    mask = lambda n: FieldSpec(n, 0.25, 0.0, "dice", "bitmask", 8)
    i = b"\xde\xad\xbe\x0f"
    if kind == "simple":
        return LinkageConfig.of([integer("int_1")], 0.9, 0.7), [{"int_1": i}], [{"int_1": i}] * 3, (0, True, True, 2096128, 2096128)
    if kind == "mask":
        return LinkageConfig.of([mask("bm_1")], 0.9, 0.7), [{"bm_1": b"\x77"}], [{"bm_1": b"\xee"}] * 3, (0, False, False, 1398101, 2096128)
    c = LinkageConfig.of([mask("bm_1"), mask("bm_2")], 0.9, 0.7)
    return c, [{"bm_1": None, "bm_2": b"\x44"}], [{"bm_1": None, "bm_2": b"\x43"}, {"bm_1": b"\x31", "bm_2": b"\x44"}], (1, True, True, 1047552, 1047552)


@pytest.mark.parametrize("kind", ["simple", "mask", "empty"])
def test_golden_fixtures(spark, kind):
    config, client, server, want = fixture(kind)
    got = rows(LinkageEngine(config).link(*frames(spark, config, client, server)))
    assert got == [want] == link(config, "int32", client, server)


def test_golden_exchange_group(spark):
    # Two equal integers of weight 1.0 and 3.0; two masks in a group, weights 3 and 3.
    config = LinkageConfig.of([FieldSpec("int_1", 0.5, 0.0, "binary", "integer", 29), FieldSpec("int_2", 0.125, 0.0, "binary", "integer", 29),
                               FieldSpec("bm_1", 0.125, 0.0, "dice", "bitmask", 8), FieldSpec("bm_2", 0.125, 0.0, "dice", "bitmask", 8)], 0.9, 0.7, [["bm_1", "bm_2"]])
    same = {"int_1": b"\1\2\3\4", "int_2": b"\4\3\2\1"}
    client, server = [same | {"bm_1": b"\x33", "bm_2": b"\x43"}], [same | {"bm_1": b"\x44", "bm_2": b"\x35"}] * 2
    for mode in MODES:
        got = rows(LinkageEngine(config, mode).link(*frames(spark, config, client, server)))
        close(got, link(config, mode, client, server), mode)
    # Swapped masks: dice(33,35) = 6/8 and dice(43,44) = 2/5.
    exact = rows(LinkageEngine(config, "exact").link(*frames(spark, config, client, server)))[0]
    assert exact[3:] == pytest.approx((4 + 3 * 0.75 + 3 * 0.4, 10.0))


def records(rng, config, n, empty=0.25):
    pool = {name: [bytes(rng.randrange(256) for _ in range(s.nbytes)) for _ in range(4)] + [b"\0" * s.nbytes] for name, s in config.fields.items()}
    for group in config.groups:
        for name in group:
            pool[name] = pool[group[0]]
    return [{name: None if rng.random() < empty else rng.choice(pool[name]) for name in config.names} for _ in range(n)]


def config_of(groups, n_masks=4, n_ints=2, bits=24):
    fields = [FieldSpec(f"m{i}", 0.01 * (i + 1), 0.01, "dice", "bitmask", bits) for i in range(n_masks)] + [FieldSpec(f"n{i}", 0.05, 0.02 * i, "binary", "integer", 9) for i in range(n_ints)]
    return LinkageConfig.of(fields, 0.75, 0.5, groups)


@pytest.mark.parametrize("groups", [[], [["m0", "m1"]], [["m0", "m1", "m2"], ["n0", "n1"]], [["m0", "m1", "m2", "m3"]]])
@pytest.mark.parametrize("mode", MODES)
def test_equals_row_by_row_evaluation(spark, groups, mode):
    rng, config = random.Random(len(groups)), config_of(groups)
    client, server = records(rng, config, 12), records(rng, config, 25)
    left, right = frames(spark, config, client, server)
    want = link(config, mode, client, server)
    for kernel in ("sql", "arrow"):
        close(rows(LinkageEngine(config, mode, kernel=kernel).link(left, right)), want, mode)


@pytest.mark.parametrize("kernel", ["sql", "arrow"])
def test_block_join_and_both_broadcasts(spark, monkeypatch, kernel):
    rng, config = random.Random(9), config_of([["m0", "m1"]])
    client, server = records(rng, config, 17), records(rng, config, 11)
    left, right = frames(spark, config, client, server)
    want = link(config, "int32", client, server)
    assert rows(LinkageEngine(config, kernel=kernel).link(left, right)) == want
    more = LinkageEngine(config, kernel=kernel).link(right.withColumnRenamed("row_idx", "record_idx"), left.withColumnRenamed("record_idx", "row_idx"))
    assert rows(more) == link(config, "int32", server, client)
    monkeypatch.setattr(e, "BLOCK_ROWS", 4)
    blocked = LinkageEngine(config, broadcast_rows=0, kernel=kernel)
    assert rows(blocked.link(left, right)) == want
    c = blocked.count(left, right).first()
    assert (c["matches"], c["tentative_matches"]) == (sum(w[1] for w in want), sum(w[2] for w in want))


def test_place_in_runs_beyond_one(spark):
    # Equal rows far apart: the first index wins across runs of packed places.
    config, client, _, _ = fixture("simple")
    names = "row_idx bigint, id string, int_1 binary"
    server = spark.createDataFrame([(i, str(i), b"\xde\xad\xbe\x0f" if i >= 2**25 else b"\0\0\0\0") for i in (5, 2**25 + 3, 2**25 + 9, 2**40)], names)
    left, _ = frames(spark, config, client, [])
    for mode in MODES:
        for kernel in ("sql", "arrow"):
            assert LinkageEngine(config, mode, kernel=kernel).link(left, server).first()["best_index"] == 2**25 + 3


def test_empty_sides(spark):
    config, client, server, _ = fixture("empty")
    left, right = frames(spark, config, client, server)
    for mode, kernel in [(m, k) for m in MODES for k in ("sql", "arrow")]:
        LinkageEngine = lambda c, m: e.LinkageEngine(c, m, kernel=kernel)  # noqa: E731, N806
        r = LinkageEngine(config, mode).link(left, right.limit(0)).first()
        assert (r["best_index"], r["best_id"], r["match"], r["tentative_match"], r["sum_weights"]) == (None, None, False, False, 0)
        assert LinkageEngine(config, mode).link(left.limit(0), right).count() == 0
        assert tuple(LinkageEngine(config, mode).count(left, right.limit(0)).first()) == (0, 0)
        blank = left.withColumns({n: F.lit(None).cast("binary") for n in config.names})
        r = LinkageEngine(config, mode).link(blank, right).first()
        assert (r["best_index"], r["match"], r["sum_weights"]) == (0, False, 0)


def test_strict_threshold(spark):
    # A score equal to the threshold doesn't match.
    config = LinkageConfig.of([FieldSpec("m", 0.25, 0.0, "dice", "bitmask", 8)], 0.5, 0.5)
    left, right = frames(spark, config, [{"m": b"\x03"}], [{"m": b"\x05"}])
    for mode in ("int32", "int64", "exact"):
        r = LinkageEngine(config, mode).link(left, right).first()
        assert r["sum_field_weights"] * 2 == r["sum_weights"] and not r["match"]


def test_row_order_changes_ties_only(spark):
    rng, config = random.Random(3), config_of([["m0", "m1", "m2"]])
    client, server = records(rng, config, 10), records(rng, config, 20)
    a = rows(LinkageEngine(config).link(*frames(spark, config, client, server)))
    b = rows(LinkageEngine(config).link(*frames(spark, config, client, server[::-1])))
    assert [x[1:] for x in a] == [x[1:] for x in b]
    assert all(not m or t for _, m, t, _, _ in a)


def test_swapping_members_of_equal_weight_changes_nothing(spark):
    config = LinkageConfig.of([FieldSpec(f"m{i}", 0.01, 0.01, "dice", "bitmask", 24) for i in range(3)], 0.75, 0.5, [["m0", "m1", "m2"]])
    rng = random.Random(6)
    client, server = records(rng, config, 8), records(rng, config, 8)
    swapped = [{"m0": r["m2"], "m1": r["m0"], "m2": r["m1"]} for r in client]
    assert rows(LinkageEngine(config).link(*frames(spark, config, client, server))) == rows(LinkageEngine(config).link(*frames(spark, config, swapped, server)))


def test_keys_order_like_cross_products(spark):
    rng, config = random.Random(1), person_config()
    p = Precision.of("int32", config)
    layout = fold.PackedKey.of(p, config)
    pairs = [(0, 0)]
    for _ in range(3000):
        w = rng.randrange(1, 8 * 511 + 1)
        pairs.append((rng.randrange(0, (w << p.dice) + 1) if rng.random() < 0.5 else min(w << p.dice, (w * 200) + rng.randrange(3)), w))
    df = spark.createDataFrame([(i, f, w) for i, (f, w) in enumerate(pairs)], "i int, f bigint, w bigint")
    got = df.select("i", layout.pack(F.col("f"), F.col("w")).alias("k")).withColumns({"f": layout.num_of(F.col("k")), "w": layout.den_of(F.col("k"))}).collect()
    from plain import order

    by_key = [pairs[r["i"]] for r in sorted(got, key=lambda r: r["k"])]
    ranks = [order(*x) for x in by_key]
    assert ranks == sorted(ranks)
    assert all((r["f"], r["w"]) == pairs[r["i"]] for r in got)


def test_records_must_have_the_fields(spark):
    config, client, server, _ = fixture("simple")
    left, right = frames(spark, config, client, server)
    with pytest.raises(ValueError, match="lack"):
        LinkageEngine(config).link(left.drop("int_1"), right)
    with pytest.raises(ValueError, match="encoded"):
        LinkageEngine(config).link(left.withColumn("int_1", F.lit(1)), right)


def test_synthetic_inputs(spark):
    config = person_config()
    client, server = RandomInput(config, forced_empty=("ort",)).generate(spark, 300, 20)
    again = RandomInput(config, forced_empty=("ort",)).generate(spark, 300, 20)[1].repartition(7)
    assert sorted(map(str, server.collect())) == sorted(map(str, again.collect()))
    assert client.filter("ort IS NOT NULL").count() == 0
    here = server.select([F.count(n).alias(n) for n in config.names]).first().asDict()
    assert all(190 < v < 280 for v in here.values())
    left, right = [r.asDict() for r in client.collect()], [r.asDict() for r in server.orderBy("row_idx").collect()]
    clean = lambda rs: [{n: None if r[n] is None else bytes(r[n]) for n in config.names} for r in rs]
    got = rows(LinkageEngine(config).link(client, server))
    assert got == link(config, "int32", clean(left), clean(right))
    dense = RandomInput(bench_config(2), density=2).generate(spark, 30, 3)[0].first()
    thin = RandomInput(bench_config(2), density=-2).generate(spark, 30, 3)[0].first()
    ones = lambda b: sum(bin(x).count("1") for x in b)
    assert ones(dense["bm_0"]) > 380 and ones(thin["bm_0"]) < 110


def test_modes_agree_within_tolerance(spark):
    config = person_config()
    client, server = RandomInput(config).generate(spark, 60, 8)
    for r in score_table(config, client, server).collect():
        exact = r["num_exact"] / r["den_exact"]
        assert r["num_int64"] / r["den_int64"] == pytest.approx(exact, rel=1e-4)
        assert r["num_int32"] / r["den_int32"] == pytest.approx(exact, rel=2e-2)
    p = Precision.of("int32", config)
    a, b = client.first().asDict(), server.first().asDict()
    assert pair(config, p, a, b)[1] > 0


@pytest.mark.parametrize("mode", ["int8", *MODES])
def test_equality_is_looked_up(spark, monkeypatch, mode):
    # Same rows as all pairs give, with empty fields, copies and equal quotients, and no pair is made.
    rng = random.Random(11)
    config = LinkageConfig.of([FieldSpec(f"n{i}", f, 0.01, "binary", "integer", 2) for i, f in enumerate((0.04, 0.001, 0.09, 0.04))], 0.8, 0.5)
    make = lambda n: [{c: None if rng.random() < 0.3 else bytes([rng.randrange(4)]) for c in config.names} for _ in range(n)]
    client, server = make(40) + [dict.fromkeys(config.names)], make(60)
    left, right = frames(spark, config, client, server)
    want = link(config, mode, client, server)
    for few in (server[:3], [dict.fromkeys(config.names)] + server[:5]):
        close(rows(LinkageEngine(config, mode).link(left, frames(spark, config, client, few)[1])), link(config, mode, client, few), mode)
    monkeypatch.setattr(LinkageEngine, "pairs", None)
    close(rows(LinkageEngine(config, mode).link(left, right)), want, mode)
    c = LinkageEngine(config, mode).count(left, right).first()
    assert (c["matches"], c["tentative_matches"]) == (sum(w[1] for w in want), sum(w[2] for w in want))


@pytest.mark.parametrize("op", fold.OPS)
def test_folds_equal_those_over_all_scores(spark, op):
    rng, config = random.Random(13), config_of([["m0", "m1", "m2"]])
    left, right = frames(spark, config, records(rng, config, 14), records(rng, config, 30))
    for mode in ("int16", "int32"):
        engine = LinkageEngine(config, mode)
        got = engine.fold(left, right, op)
        want = fold.fold(engine.scores(left, right), op, "num", "den", "row_idx", by=["record_idx"], place="row_idx")
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("op", fold.OPS)
@pytest.mark.parametrize("mode", MODES)
def test_few_pairs_are_scored_and_none_is_missed(monkeypatch, mode, op):
    import numpy as np
    import pyarrow as pa
    from kinlink.operators import kernel as k

    config = LinkageConfig.of([*[FieldSpec(f"m{i}", 0.001 * (i + 1), 0.01, "dice", "bitmask", 16) for i in range(4)], FieldSpec("n", 0.1, 0.02, "binary", "integer", 4)], 0.9, 0.7, [["m0", "m1", "m2"]])

    def side(n, seed):
        rng, data = np.random.default_rng(seed), {"key": pa.array(np.random.default_rng(seed).permutation(n))}
        for name, spec in config.fields.items():
            here = rng.random(n) < (0.8 if name in ("m1", "n") else 2)
            word = np.where(here, rng.integers(0, 1 << 16, n).astype(np.int64) << 48 if spec.comparator == "dice" else rng.integers(0, 8, n).astype(np.int64) << 56, 0)
            extra = np.where(here, np.bitwise_count(word.view(np.uint64)) if spec.comparator == "dice" else 1, 0).astype(np.int64)
            data |= {f"{name}_here": pa.array(here), f"{name}_extra": pa.array(extra), f"{name}_w0": pa.array(word)}
        return k.Side(pa.table(data), config)

    client, server = side(50, 1), side(2000, 2)
    kernel = k.Kernel(config, Precision.of(mode, config), op)
    num, den = kernel.scores(k.Pairs(config, client, slice(0, 50), server, slice(0, 2000)))
    want = []
    for r, record in enumerate(client.key):
        by = np.lexsort((server.key, *(-key[r] for key in kernel.order(num, den)[::-1])))
        want.append((int(record), int(server.key[by[0]]), num[r, by[0]], den[r, by[0]]))
    seen, score = [], kernel.scores
    monkeypatch.setattr(kernel, "scores", lambda pairs: seen.append(int(np.prod(pairs.shape))) or score(pairs))
    monkeypatch.setattr(k, "BOUNDED", 1 << 12)
    best, = k.meet([kernel], client, iter([server]))
    assert sorted(zip(*(x.tolist() for x in best.rows()))) == sorted(want)
    assert sum(seen) < 50 * 2000 / (4 if mode == "int16" else 20)


@pytest.mark.parametrize("mode", ["int32", "exact"])
def test_equal_rows_win_without_pairs(spark, monkeypatch, mode):
    rng = random.Random(17)
    fields = [FieldSpec("m", 0.001, 0.01, "dice", "bitmask", 500 if mode == "int32" else 24), FieldSpec("a", 0.04, 0.01, "binary", "integer", 2), FieldSpec("b", 0.09, 0.01, "binary", "string", 304)]
    config = LinkageConfig.of(fields, 0.8, 0.5)
    server = records(rng, config, 60)
    client = [dict(r) for r in server[::3]] + [{**r, "a": None} for r in server[:12]] + [dict.fromkeys(config.names)]
    other = [{**r, "m": bytes(rng.randrange(256) for _ in range(fields[0].nbytes))} for r in server[:9]]
    for kernel in ("arrow", "auto"):
        left, right = frames(spark, config, client + other, server)
        close(rows(LinkageEngine(config, mode, kernel=kernel).link(left, right)), link(config, mode, client + other, server), mode)
    few = [r for r in client if r["m"] is None or any(r["m"])]
    monkeypatch.setattr(e, "local_best", None)
    left, right = frames(spark, config, few, server)
    close(rows(LinkageEngine(config, mode).link(left, right)), link(config, mode, few, server), mode)


def test_all_pairs_are_written_in_tiles(spark, monkeypatch):
    from kinlink.plans.catalog import QUERIES

    monkeypatch.setattr(e, "TILE_ROWS", 8, raising=False)
    got = QUERIES["pair_scores"](spark, "/root/testdata/sf0.001").collect()
    records, rows_ = {r["record_idx"] for r in got}, {r["row_idx"] for r in got}
    assert len(records) > 100 and len(got) == len(records) * len(rows_) == len({r[:2] for r in got})
    assert len({r["record_idx"] for r in got[:32]}) <= 16  # not 32 different ones, for which the result takes more disk


@pytest.mark.parametrize("sizes", [(0, 5), (5, 0), (3, 40), (40, 3)])
def test_tiles_hold_every_pair(spark, monkeypatch, sizes):
    monkeypatch.setattr(e, "TILE_ROWS", 4, raising=False)
    config = LinkageConfig.of([FieldSpec("bm_1", 0.25, 0.0, "dice", "bitmask", 8), FieldSpec("bm_2", 0.125, 0.0, "dice", "bitmask", 8)], 0.9, 0.7, [["bm_1", "bm_2"]])
    rng = random.Random(11)
    sides = frames(spark, config, *[records(rng, config, n) for n in sizes])
    odd = [s.withColumn(c, F.when(F.col(c) % 7 == 3, F.lit(None)).when(F.col(c) % 5 == 2, F.lit(-8)).otherwise(F.col(c) * 8).cast("bigint")) for s, c in zip(sides, ("record_idx", "row_idx"))]
    order = lambda df: sorted(map(repr, df.collect()))
    engine = LinkageEngine(config)
    assert order(engine.scores(*odd, tiled=True)) == order(engine.scores(*odd)) and engine.scores(*odd, tiled=True).count() == sizes[0] * sizes[1]


def test_documents_are_linked_without_pairs(spark, monkeypatch):
    # The view's masks fit whole-stage code, but a labelled document equals its own row: no pair is made.
    from duck import assert_same
    from kinlink.plans.catalog import QUERIES, SQL

    monkeypatch.setattr(LinkageEngine, "pairs", None)
    monkeypatch.setattr(e, "local_best", None)
    assert_same(QUERIES["link_documents"](spark, "/root/testdata/sf0.001"), SQL["link_documents"], "/root/testdata/sf0.001")


@pytest.mark.parametrize("kernel", ["auto", "sql"])
def test_narrow_masks_meet_rows_only_without_an_equal_one(spark, kernel):
    rng = random.Random(23)
    fields = [FieldSpec("m", 0.001, 0.01, "dice", "bitmask", 60), FieldSpec("a", 0.04, 0.01, "binary", "integer", 2)]
    config = LinkageConfig.of(fields, 0.8, 0.5)
    server = records(rng, config, 40)
    client = [dict(r) for r in server[::3]] + records(rng, config, 20) + [dict.fromkeys(config.names), {"m": bytes(8), "a": None}]
    left, right = frames(spark, config, client, server)
    engine = LinkageEngine(config, kernel=kernel)
    assert not engine.uses_arrow
    close(rows(engine.link(left, right)), link(config, "int32", client, server), "int32")


def test_words_are_those_of_each_row(spark, tmp_path):
    # Rows of one doc_id keep their own words, as in SQL; blanks at the ends, runs of them, none at all, other white space.
    from duck import assert_same
    from kinlink.plans.catalog import QUERIES, SQL

    texts = ["a b", "b  c\n\r\td", " a", "a ", "", " ", "\n", None, "AÉß b\x0bc", "a b", "x" * 300 + " y", "a b", "c d"]
    docs = [(n if n < 12 else 0, t, ["en", None, "de"][n % 3], "s" if n % 2 else None) for n, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(n, 1) for n in range(1, 12)], "doc_id bigint, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    assert_same(QUERIES["link_documents"](spark, str(tmp_path)), SQL["link_documents"], str(tmp_path))
