"""Text and TOML reports of results and runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinlink.operators.score import deviation_percent, score


def result_report(links: DataFrame, exact: DataFrame, digits: tuple[int, int] = (6, 4)) -> DataFrame:
    """One line per record: flags, best row, score, percent off the exact score.

    ``digits`` after the point of the score and of the percents.
    """
    s, e = score(F.col("sum_field_weights"), F.col("sum_weights")), score(F.col("e_num"), F.col("e_den"))
    both = links.join(exact.select("record_idx", F.col("sum_field_weights").alias("e_num"), F.col("sum_weights").alias("e_den")), "record_idx")
    line = F.format_string(f"record %d: best %s, match %s, tentative %s, score %.{digits[0]}f, deviation %.{digits[1]}f%%", "record_idx",
                           F.coalesce(F.col("best_index").cast("string"), F.lit("-")), F.col("match").cast("string"), F.col("tentative_match").cast("string"),
                           F.coalesce(s, F.lit(0.0)), F.coalesce(deviation_percent(s, e), F.lit(0.0)))
    return both.select("record_idx", line.alias("line"))


def _stages(spark: SparkSession, store) -> list:
    """What the status store knows of the stages so far."""
    found = store.stageList(spark.sparkContext._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


@dataclass
class RunStatistics:
    """Times, memory and exchanged data of a run, with its parameters, as TOML."""

    parameters: dict[str, object]
    seconds: dict[str, float]
    rows: int = 0
    #: As Spark measures them over the run's stages: CPU seconds of tasks, bytes that
    #: stages exchanged, the largest peak of a task's execution memory.
    resources: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, parameters: dict[str, object], plan: Callable[[], DataFrame]) -> tuple[RunStatistics, list]:
        """Run a plan of few rows, and its rows."""
        rows: list = []
        return cls.measured(parameters, plan, lambda df: rows.extend(df.collect())), rows

    @classmethod
    def measured(cls, parameters: dict[str, object], plan: Callable[[], DataFrame], write: Callable[[DataFrame], object] | None = None) -> RunStatistics:
        """Run a plan to its end; ``write`` says where its rows go (by default nowhere)."""
        t = time.time()
        df = plan()
        seen = Observation("run")
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        planned, store = time.time() - t, df.sparkSession._jsparkSession.sparkContext().statusStore()
        before = {s.stageId() for s in _stages(df.sparkSession, store)}
        (write or (lambda x: x.write.format("noop").mode("overwrite").save()))(counted)
        seconds = {"setup": planned, "online": time.time() - t - planned}
        stages = [s for s in _stages(df.sparkSession, store) if s.stageId() not in before]
        used = {"cpu_seconds": sum(s.executorCpuTime() for s in stages) / 1e9, "exchanged_bytes": sum(s.shuffleWriteBytes() for s in stages),
                "peak_memory_bytes": max((s.peakExecutionMemory() for s in stages), default=0)}
        return cls(parameters, seconds, int(seen.get["rows"]), used)

    def to_toml(self) -> str:
        def value(v: object) -> str:
            return str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else f'"{v}"'

        lines = ["[parameters]", *[f"{k} = {value(v)}" for k, v in self.parameters.items()], "", "[timing]", *[f"{k} = {v:.6f}" for k, v in self.seconds.items()],
                 "", "[resources]", *[f"{k} = {value(v)}" for k, v in self.resources.items()], "", "[result]", f"rows = {self.rows}"]
        return "\n".join(lines) + "\n"
