import pytest
from kinlink.operators import fold, stats
from pyspark.sql import functions as F


def test_run_stats(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "x"), ("b", 5.0, "y")], "k string, t double, p string")
    got = {r["k"]: r for r in stats.run_stats(df, ["k"], ["t"], ["p"]).collect()}
    assert (got["a"]["runs"], got["a"]["t_mean"], got["a"]["t_max"], got["a"]["p"]) == (2, 2.0, 3.0, "x")
    assert got["a"]["t_stdev"] == pytest.approx(2**0.5) and got["b"]["t_stdev"] == 0.0


def test_joins_flatten_and_groups(spark, tmp_path):
    a = spark.createDataFrame([(1, 2), (2, 3)], "size int, t int")
    j = stats.join_runs([a, a, a.filter("size = 1")], "size")
    assert [tuple(r) for r in j.collect()] == [(1, 2, 2, 2)] and j.columns == ["size", "t", "t_2", "t_3"]
    n = a.select(F.struct("size", F.struct("t").alias("in")).alias("p"), "t")
    assert stats.flatten(n).columns == ["p.size", "p.in.t", "t"]
    stats.write_by_group(a, str(tmp_path / "g"), "size", "t")
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).count() == 2
    c = stats.with_communication(a, "size", "t", "comm")
    assert [r["comm"] for r in c.orderBy("size").collect()] == [3, 5]


def test_deviations(spark):
    t = spark.createDataFrame([(0, 50, 100, 0.4, 1.0), (1, 0, 0, 0.0, 0.0)], "record_idx int, num_int16 int, den_int16 int, num_exact double, den_exact double")
    d = stats.deviations(t, ["int16"])
    assert [r["dev_int16"] for r in d.orderBy("record_idx").collect()] == pytest.approx([25.0, 0.0])
    r = stats.deviation_stats(d, ["int16"]).first()
    assert r["mode"] == "int16" and (r["min_dev"], r["max_dev"], r["mean_dev"]) == pytest.approx((0.0, 25.0, 12.5))


@pytest.mark.parametrize("op, want", [("MAX", (1, 2, 0)), ("MAX_TIE", (2, 4, 1)), ("MIN", (0, 0, 4)), ("MIN_TIE", (0, 0, 4))])
def test_folds(spark, op, want):
    rows = [(1, 2, 0), (2, 4, 1), (1, 3, 2), (2, 4, 3), (0, 0, 4)]
    df = spark.createDataFrame(rows, "num bigint, den bigint, i bigint")
    assert tuple(fold.fold(df, op, "num", "den", "i", place="i").first()) == want
    doubles = df.select(F.col("num").cast("double"), F.col("den").cast("double"), "i")
    assert tuple(fold.fold(doubles, op, "num", "den", "i", place="i").first()) == want
    with pytest.raises(ValueError):
        fold.fold(df, "SUM", "num", "den")


def test_accumulate_and_select(spark):
    df = spark.createDataFrame([(3, "a", 0), (7, "b", 1), (7, "c", 2)], "v bigint, t string, i bigint")
    assert fold.accumulate(df, "v", "sum").first()[0] == 17 and fold.accumulate(df, "v", "max").first()[0] == 7
    assert tuple(fold.select_target(df, "v", "t", place="i").first()) == (7, "b")
