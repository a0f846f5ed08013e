import pytest
from duck import assert_same
from kinlink.llm import mixing


def test_equals_sql(spark, sf_dir):
    assert_same(mixing.op7_mix_sources(spark, sf_dir), mixing.mix_sql(), sf_dir)


def test_odd_rows_equal_sql(odd, sf_dir):
    got = mixing.mix(odd.drop("size"))
    docs = odd.select("doc_id", "source", "text").toPandas()
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    assert_same(got.select("doc_id", "size", "source_size", "target", "taken"), mixing.mix_sql("docs"), sf_dir, docs=docs)
    assert set(odd.columns) <= set(mixing.mix(odd).columns)
    assert mixing.mix(odd).filter("taken > 3 * size").count() == 0


def test_targets_are_filled_by_weight(spark):
    rows = [(i, " ".join(["w"] * 10), s) for i, s in enumerate("a" * 2 + "b" * 300 + "c" * 300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=4).groupBy("source").agg({"target": "first", "taken": "sum"}).collect()
    target = {r["source"]: r["first(target)"] for r in got}
    taken = {r["source"]: r["sum(taken)"] for r in got}
    assert target["a"] == 60.0  # three times its 20 words
    assert target["b"] == pytest.approx(2 * target["c"])
    assert sum(target.values()) == pytest.approx(6020)
    assert all(abs(taken[s] - target[s]) <= 4 for s in target)


def test_quotas_are_sainte_lague_and_add_up(spark):
    sizes = {"a": 530, "b": 240, "c": 230}
    t = spark.createDataFrame([("v" + s, n, float(n)) for s, n in sizes.items()], "__skey string, source_size bigint, target double")
    rows = mixing.shard_quotas(t, block=10, shards=4).collect()
    seats = {s: 0 for s in sizes}
    for _ in range(100):
        best = max(sorted(sizes), key=lambda s: sizes[s] / (2 * seats[s] + 1))
        seats[best] += 1
    assert {s: sum(r["quota"] for r in rows if r["__skey"] == "v" + s) for s in sizes} == seats
    for k in range(4):
        assert sum(r["quota"] for r in rows if r["shard"] == k) == 25


def test_empty(none):
    assert mixing.mix(none).count() == 0


def test_shards_choose_their_own_blocks(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    got = mixing.mix(docs)
    text = F.array_join(F.col("shard_taken").cast("array<string>"), ",").alias("shard_taken")
    assert_same(got.select("doc_id", "size", "source_size", "target", "taken", text), mixing.mix_sql(by_shard=True), sf_dir)
    rows = got.select("source", "size", "taken", "shard_taken").collect()
    assert all(len(r["shard_taken"]) == mixing.SHARDS and min(r["shard_taken"]) >= 0 and sum(r["shard_taken"]) == r["taken"] for r in rows)
    # Every shard takes its quota's words of a source.
    t = mixing.source_targets(mixing._line(docs, mixing.SEED, mixing.n_words(F.col("text")), mixing.text_key(F.col("text"))).groupBy("__skey", "__sub").agg(F.sum("__size").alias("__part")))
    want = {(r["__skey"], r["shard"]): r["quota"] * mixing.BLOCK for r in mixing.shard_quotas(t).collect()}
    have = {}
    for r in rows:
        for k, n in enumerate(r["shard_taken"]):
            key = ("n" if r["source"] is None else "v" + r["source"], k)
            have[key] = have.get(key, 0) + n
    assert all(want[x] - mixing.BLOCK < have[x] <= want[x] for x in want) and len(want) > 8


def test_tiny_sources_reach_their_targets(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 20, "b"), *[(k, "w " * 50, "c") for k in range(3, 90)]]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).groupBy("source").agg({"target": "first", "taken": "sum"}).collect()
    got = {r["source"]: (r["first(target)"], r["sum(taken)"]) for r in got}
    assert got["a"] == (30.0, 30) and got["b"] == (60.0, 60) and abs(got["c"][0] - got["c"][1]) <= 64


def test_rows_without_an_id_and_odd_names(spark):
    from pyspark.sql import functions as F

    df = spark.range(300).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.lit("s").alias("source"), F.lit(7).alias("__size"), F.lit(8).alias("__b"))
    got = mixing.mix(df)
    assert got.columns[:5] == ["doc_id", "text", "source", "__size", "__b"]
    rows = got.collect()
    assert {(r["__size"], r["__b"]) for r in rows} == {(7, 8)} and sum(r["taken"] for r in rows) == 300 * 3 // 32 * 32
