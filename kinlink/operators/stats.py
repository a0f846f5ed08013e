"""Benchmark runs: grouping, joins, deviations between numeric modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stats(runs: DataFrame, by: list[str], values: list[str], keep: list[str] = ()) -> DataFrame:
    """Per group: number of runs, and mean, largest value and sample deviation of values.

    The deviation of a single run is 0.  ``keep``: columns of which any value is kept.
    """
    out = [F.count(F.lit(1)).alias("runs")]
    for v in values:
        out += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_stdev")]
    return runs.groupBy(*by).agg(*out, *[F.min(k).alias(k) for k in keep])


def join_runs(tables: list[DataFrame], key: str) -> DataFrame:
    """Tables of one key side by side; later columns get their table's number."""
    renamed = [t if k == 0 else t.select(key, *[F.col(c).alias(f"{c}_{k + 1}") for c in t.columns if c != key]) for k, t in enumerate(tables)]
    return reduce(lambda a, b: a.join(b, key), renamed)


def with_communication(runs: DataFrame, sent: str, received: str, name: str) -> DataFrame:
    return runs.withColumn(name, F.col(sent) + F.col(received))


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with joined names, to any depth."""
    from pyspark.sql.types import StructType

    def walk(schema, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out += walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at)))
        return out

    return df.select(*walk(df.schema, ()))


def write_by_group(df: DataFrame, path: str, group: str, order: str | None = None) -> None:
    """One folder per value of ``group``, rows sorted by ``order`` in each file."""
    df = df.repartition(group)
    (df.sortWithinPartitions(group, order) if order else df).write.mode("overwrite").partitionBy(group).option("header", True).csv(path)


def deviations(table: DataFrame, modes: list[str], reference: str = "exact") -> DataFrame:
    """Percent by which scores of fixed-point modes differ from the reference's."""
    def score(m: str) -> Column:
        return F.try_divide(F.col(f"num_{m}").cast("double"), F.col(f"den_{m}").cast("double"))

    ref = score(reference)
    return table.select("record_idx", *[F.coalesce(F.try_divide(score(m) - ref, ref) * 100, F.lit(0.0)).alias(f"dev_{m}") for m in modes])


def deviation_stats(devs: DataFrame, modes: list[str]) -> DataFrame:
    """Rows (mode, min, max, mean) over all records."""
    aggs = [f(f"dev_{m}").alias(f"{n}_{m}") for m in modes for n, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg))]
    row = devs.agg(*aggs)
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"lo_{m}").alias("min_dev"), F.col(f"hi_{m}").alias("max_dev"), F.col(f"avg_{m}").alias("mean_dev")) for m in modes])).alias("r")).select("r.*")


def describe(df: DataFrame, values: list[str], by: list[str] = ()) -> DataFrame:
    """Rows (value, n, mean, stdev, least, q1, median, q3, most); quartiles are interpolated."""
    out = None
    for v in values:
        c = F.col(v).cast("double")
        part = (df.groupBy(*by) if by else df).agg(
            F.count(c).alias("n"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("stdev"), F.min(c).alias("least"),
            F.percentile(c, F.lit(0.25)).alias("q1"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.75)).alias("q3"), F.max(c).alias("most"))
        part = part.select(*by, F.lit(v).alias("value"), "n", "mean", "stdev", "least", "q1", "median", "q3", "most")
        out = part if out is None else out.union(part)
    return out
