"""Random linkage inputs, seeded and reproducible on any number of partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions.codec import int_bytes, mask_bits
from kinlink.plans.config import FieldSpec, LinkageConfig


def person_config(threshold: float = 0.9, tentative: float = 0.7) -> LinkageConfig:
    """Eight fields of a person; the three names may be swapped."""
    # Frequency, error rate, comparator, type and bits per field.
    rows = (
        ("vorname", 0.000235, 0.01, "dice", "bitmask", 500), ("nachname", 0.0000271, 0.008, "dice", "bitmask", 500),
        ("geburtsname", 0.0000271, 0.008, "dice", "bitmask", 500), ("geburtstag", 0.0333, 0.005, "binary", "integer", 5),
        ("geburtsmonat", 0.0833, 0.002, "binary", "integer", 4), ("geburtsjahr", 0.0286, 0.004, "binary", "integer", 11),
        ("plz", 0.01, 0.04, "binary", "string", 40), ("ort", 0.01, 0.04, "dice", "bitmask", 500),
    )
    return LinkageConfig.of([FieldSpec(*r) for r in rows], threshold, tentative, [["vorname", "nachname", "geburtsname"]])


def bench_config(n: int, kind: str = "combined", threshold: float = 0.9, tentative: float = 0.7) -> LinkageConfig:
    """n fields of 12-bit integers, of 500-bit masks, or n of each."""
    # Bits, frequency and error rate of the fields.
    fields = []
    if kind in ("integer", "combined"):
        fields += [FieldSpec(f"int_{i}", 0.01, 0.04, "binary", "integer", 12) for i in range(n)]
    if kind in ("bitmask", "combined"):
        fields += [FieldSpec(f"bm_{i}", 0.01, 0.04, "dice", "bitmask", 500) for i in range(n)]
    if not fields:
        raise ValueError("kind is integer, bitmask or combined")
    return LinkageConfig.of(fields, threshold, tentative)


@dataclass(frozen=True)
class RandomInput:
    """Client records and a server database with controlled gaps and copies."""

    config: LinkageConfig
    seed: int = 73
    empty: float = 0.2
    copied: float = 0.5
    density: int = 0
    forced_empty: tuple[str, ...] = ()

    def _text(self, what: str, *key: Column) -> Column:
        """32 hexadecimal digits from seed, name and key, which any engine can compute."""
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), F.lit(what), *[k.cast("string") for k in key]))

    def _whole(self, what: str, *key: Column) -> Column:
        """A number below 2^60."""
        return F.conv(F.substring(self._text(what, *key), 1, 15), 16, 10).cast("bigint")

    def _uniform(self, what: str, *key: Column) -> Column:
        return F.pmod(self._whole(what, *key), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def _mask(self, spec: FieldSpec, what: str, idx: Column) -> Column:
        """Random bytes; each step of density ORs (or ANDs) another random byte."""
        if not self.density:
            whole = F.concat(*[self._text(f"{what}.{spec.name}.{k}", idx) for k in range(-(-spec.nbytes // 16))])
            return mask_bits(F.unhex(F.substring(whole, 1, 2 * spec.nbytes)), spec.bitsize)
        word = lambda name: F.conv(F.substring(self._text(name, idx), 1, 16), 16, -10).cast("bigint")
        words = []
        for w in range(-(-spec.nbytes // 8)):
            x = word(f"{what}.{spec.name}.{w}")
            for k in range(abs(self.density)):
                y = word(f"{what}.{spec.name}.{w}+{k}")
                x = x.bitwiseOR(y) if self.density > 0 else x.bitwiseAND(y)
            words.append(F.unhex(F.lpad(F.hex(x), 16, "0")))
        return mask_bits(F.substring(F.concat(*words), 1, spec.nbytes), spec.bitsize)

    def _value(self, spec: FieldSpec, what: str, idx: Column) -> Column:
        if spec.comparator == "dice" or spec.ftype == "bitmask":
            return self._mask(spec, what, idx)
        whole = F.pmod(self._whole(f"{what}.{spec.name}", idx), F.lit(1 << min(spec.bitsize, 32)))
        return int_bytes(whole, min(spec.nbytes, 8)) if spec.nbytes <= 8 else self._mask(spec, what, idx)

    def generate(self, spark: SparkSession, rows: int, records: int) -> tuple[DataFrame, DataFrame]:
        """(client, server); server values of equality fields are often copies."""
        client = spark.range(records).select(F.col("id").alias("record_idx"), *[
            (F.lit(None).cast("binary") if n in self.forced_empty else self._value(s, "client", F.col("id"))).alias(n) for n, s in self.config.fields.items()])
        i, source = F.col("id"), F.pmod(F.col("id"), F.lit(max(records, 1)))
        columns = []
        for n, s in self.config.fields.items():
            own = self._value(s, "server", i)
            if s.comparator == "binary" and n not in self.forced_empty:
                own = F.when(self._uniform(f"copy.{n}", i) < self.copied, self._value(s, "client", source)).otherwise(own)
            columns.append(F.when(self._uniform(f"empty.{n}", i) >= self.empty, own).alias(n))
        server = spark.range(rows).select(i.alias("row_idx"), F.concat(F.lit("id"), i.cast("string")).alias("id"), *columns)
        return client, server
