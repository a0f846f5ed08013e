"""Queries of the engine over the driver's tables, each with its DuckDB twin.

All of them run over whole tables.  ``wire`` adds those of sources, sinks and helpers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import codec, compare, shares
from kinlink.operators import fold, score, stats
from kinlink.plans import fixtures, twin, wire  # noqa: F401
from kinlink.plans.engine import LinkageEngine, score_table
from kinlink.plans.fixtures import VIEWS, table
from kinlink.plans.precision import Precision
from kinlink.plans.register import QUERIES, SQL, Query, query
from kinlink.sources.records import union_pages

INT32 = "int32"


def _sides(spark: SparkSession, sf_dir: str, view: str) -> tuple[DataFrame, DataFrame]:
    v = VIEWS[view]
    return v.client(spark, sf_dir), v.server(spark, sf_dir)


def _p(view: str, mode: str = INT32) -> Precision:
    return Precision.of(mode, VIEWS[view].config)


def _pairs(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return LinkageEngine(VIEWS[view].config).pairs(*_sides(spark, sf_dir, view))


def _sum(*cols: str) -> list:
    return [F.sum(c).cast("bigint").alias(c) for c in cols]


def _sql_sum(*cols: str) -> str:
    return ", ".join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in cols)


# --- masks -----------------------------------------------------------------------------------

@query(f"WITH r AS ({fixtures._VEC_SERVER}) SELECT row_idx, CAST(bit_count(mask) AS BIGINT) AS hw FROM r")
def hamming_weight(spark, sf_dir):
    return fixtures.vec_server(spark, sf_dir).select("row_idx", compare.hamming_weight(codec.mask_words(F.col("mask"), 1)).alias("hw"))


@query(f"WITH l AS ({fixtures._VEC_CLIENT}), r AS ({fixtures._VEC_SERVER}) SELECT row_idx, CAST(bit_count(l.mask & r.mask) AS BIGINT) AS common FROM l JOIN r ON record_idx = row_idx")
def mask_and(spark, sf_dir):
    left, right = _sides(spark, sf_dir, "vec")
    both = left.select("record_idx", codec.mask_words(F.col("mask"), 1).alias("a")).join(right.select("row_idx", codec.mask_words(F.col("mask"), 1).alias("b")), F.col("record_idx") == F.col("row_idx"))
    common = compare.hamming_weight(compare.mask_and(F.col("a"), F.col("b")))
    return both.select("row_idx", F.when(F.col("a")[0].isNotNull() & F.col("b")[0].isNotNull(), common).alias("common"))


@query("""SELECT vec_id, array_to_string(list_transform(range(8), lambda k: printf('%02X', CAST(list_sum(list_transform(range(8),
  lambda j: CASE WHEN embedding[8 * k + j + 1] > 0 THEN 1 << j ELSE 0 END)) AS INTEGER))), '') AS mask FROM embeddings""")
def bits_to_mask(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.hex(codec.bits_to_mask(F.transform("embedding", lambda x: x > 0), 64)).alias("mask"))


@query("SELECT c_custkey, base64(encode(c_name)) AS text, c_name AS back FROM customer")
def base64_roundtrip(spark, sf_dir):
    text = codec.base64_encode(F.encode("c_name", "UTF-8"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"), F.decode(codec.base64_decode(text), "UTF-8").alias("back"))


@query("""SELECT c_custkey, printf('%02X%02X', k & 255, (k >> 8) & 255) AS as_integer,
  hex(encode(left(c_name, 12))) || repeat('00', 12 - length(left(c_name, 12))) AS as_string,
  CASE WHEN trim(s) <> '' THEN hex(encode(s)) || repeat('00', 12 - length(s)) END AS with_blanks
FROM (SELECT *, CAST(floor(c_acctbal) AS BIGINT) AS k, CASE WHEN c_custkey % 3 = 0 THEN '   ' ELSE c_mktsegment END AS s FROM customer)""")
def field_decode(spark, sf_dir):
    from kinlink.plans.config import FieldSpec

    spec = lambda t, bits: FieldSpec("x", 0.1, 0.01, "binary", t, bits)
    blank = F.when(F.col("c_custkey") % 3 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.hex(codec.encode(F.floor("c_acctbal"), spec("integer", 13))).alias("as_integer"),
        F.hex(codec.encode(F.col("c_name"), spec("string", 96))).alias("as_string"), F.hex(codec.encode(blank, spec("string", 96))).alias("with_blanks"))


# --- terms -----------------------------------------------------------------------------------

_VEC_PAIRS = f"WITH l AS ({fixtures._VEC_CLIENT}), r AS ({fixtures._VEC_SERVER})"
_HERE = "l.mask IS NOT NULL AND r.mask IS NOT NULL"
_BOTH, _TOTAL = "CAST(bit_count(l.mask & r.mask) AS BIGINT)", "(CAST(bit_count(l.mask) AS BIGINT) + CAST(bit_count(r.mask) AS BIGINT))"


def _dice(spark, sf_dir, mode):
    side = lambda s: lambda part: F.col(f"{s}_mask_{part}")
    config = VIEWS["vec"].config
    value = compare.REGISTRY["dice"][1](side("l"), side("r"), config.fields["mask"], _p("vec", mode))
    return _pairs(spark, sf_dir, "vec").filter("l_mask_here AND r_mask_here").select("record_idx", value.alias("d"))


@query(f"""{_VEC_PAIRS}, d AS (SELECT record_idx, CASE WHEN {_TOTAL} = 0 THEN 0 ELSE (({_BOTH} << {_p('vec').dice + 1}) + ({_TOTAL} >> 1)) // {_TOTAL} END AS d FROM l, r WHERE {_HERE})
SELECT record_idx, CAST(sum(d) AS BIGINT) AS total, CAST(max(d) AS BIGINT) AS most FROM d GROUP BY record_idx""")
def dice_int(spark, sf_dir):
    return _dice(spark, sf_dir, INT32).groupBy("record_idx").agg(F.sum("d").cast("bigint").alias("total"), F.max("d").cast("bigint").alias("most"))


@query(f"""{_VEC_PAIRS}, d AS (SELECT record_idx, CASE WHEN {_TOTAL} = 0 THEN 0.0 ELSE (2 * {_BOTH}) / CAST({_TOTAL} AS DOUBLE) END AS d FROM l, r WHERE {_HERE})
SELECT record_idx, round(max(d), 9) AS most, round(min(d), 9) AS least FROM d GROUP BY record_idx""")
def dice_exact(spark, sf_dir):
    return _dice(spark, sf_dir, "exact").groupBy("record_idx").agg(F.round(F.max("d"), 9).alias("most"), F.round(F.min("d"), 9).alias("least"))


_PERSON = VIEWS["person"]


@query(f"""WITH l AS ({_PERSON.client_sql}), r AS ({_PERSON.server_sql})
SELECT record_idx, CAST(sum(CASE WHEN l.number = r.number THEN {1 << _p('person').dice} ELSE 0 END) AS BIGINT) AS number,
       CAST(sum(CASE WHEN (l.balance & 65535) = (r.balance & 65535) THEN {1 << _p('person').dice} ELSE 0 END) AS BIGINT) AS balance
FROM l, r GROUP BY record_idx""")
def equality_term(spark, sf_dir):
    def eq(n):
        here = F.col(f"l_{n}_here") & F.col(f"r_{n}_here")
        return F.sum(F.when(here, compare.equal(F.col(f"l_{n}_b"), F.col(f"r_{n}_b"), _p("person"))).otherwise(0)).cast("bigint").alias(n)

    return _pairs(spark, sf_dir, "person").groupBy("record_idx").agg(eq("number"), eq("balance"))


@query(f"""WITH l AS ({_PERSON.client_sql}), r AS ({_PERSON.server_sql})
SELECT record_idx, {', '.join(f'CAST(count(*) FILTER (WHERE l."{n}" IS NOT NULL AND r."{n}" IS NOT NULL) AS BIGINT) AS "{n}"' for n in _PERSON.config.names)}
FROM l, r GROUP BY record_idx""")
def empty_delta(spark, sf_dir):
    here = [F.sum((F.col(f"l_{n}_here") & F.col(f"r_{n}_here")).cast("bigint")).alias(n) for n in _PERSON.config.names]
    return _pairs(spark, sf_dir, "person").groupBy("record_idx").agg(*here)


_TERMS = [f"{x}_{a}_{b}" for a, b in score.term_pairs(VIEWS["swap"].config) for x in "fw"]


@query(f"WITH {twin.scores_cte(VIEWS['swap'], _p('swap'))} SELECT record_idx, {_sql_sum(*_TERMS)} FROM terms GROUP BY record_idx")
def field_terms(spark, sf_dir):
    terms = score.field_terms(_pairs(spark, sf_dir, "swap"), VIEWS["swap"].config, _p("swap"), ["record_idx"])
    return terms.groupBy("record_idx").agg(*_sum(*_TERMS))


@query(f"WITH {twin.scores_cte(VIEWS['swap'], _p('swap'))} SELECT record_idx, CAST(sum(b0_5_f) AS BIGINT) AS f, CAST(sum(b0_5_w) AS BIGINT) AS w FROM g0_5 GROUP BY record_idx")
def group_best_permutation(spark, sf_dir):
    config = VIEWS["swap"].config
    terms = score.field_terms(_pairs(spark, sf_dir, "swap"), config, _p("swap"), ["record_idx"])
    best = terms.select("record_idx", score.group_best(config, _p("swap"), config.groups[0]).alias("g"))
    return best.select("record_idx", "g.f", "g.w").groupBy("record_idx").agg(*_sum("f", "w"))


@query(f"WITH {twin.scores_cte(VIEWS['swap'], _p('swap'))} SELECT record_idx, row_idx, num, den FROM scores")
def pair_scores(spark, sf_dir):
    return LinkageEngine(VIEWS["swap"].config).scores(*_sides(spark, sf_dir, "swap"), tiled=True)


@query(f"""WITH {twin.scores_cte(_PERSON, _p('person'))} SELECT record_idx,
  CAST(count(*) FILTER (WHERE {_p('person').limit(_PERSON.config.threshold)} * den < num) AS BIGINT) AS matches,
  CAST(count(*) FILTER (WHERE {_p('person').limit(_PERSON.config.tentative_threshold)} * den < num) AS BIGINT) AS tentative FROM scores GROUP BY record_idx""")
def threshold_flags(spark, sf_dir):
    s, p, c = LinkageEngine(_PERSON.config).scores(*_sides(spark, sf_dir, "person")), _p("person"), _PERSON.config
    test = lambda t: F.sum(score.passes(F.col("num"), F.col("den"), p, t).cast("bigint"))
    return s.groupBy("record_idx").agg(test(c.threshold).alias("matches"), test(c.tentative_threshold).alias("tentative"))


@query("SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {b}, CAST(round(log2((1 - CAST({f.error!r} AS DOUBLE)) / CAST({f.frequency!r} AS DOUBLE)) / {VIEWS['swap'].config.max_weight!r} * {(1 << Precision.of(f'int{b}', VIEWS['swap'].config).weight) - 1}) AS BIGINT))"
    for n, f in VIEWS["swap"].config.fields.items() for b in (16, 32, 64)) + ") v(field, bits, weight)")
def rescaled_weights(spark, sf_dir):
    c = VIEWS["swap"].config
    rows = [(n, b, Precision.of(f"int{b}", c).pair_weight(c, n, n)) for n in c.names for b in (16, 32, 64)]
    return spark.createDataFrame(rows, "field string, bits int, weight bigint")


# --- linkage ---------------------------------------------------------------------------------

def _link(view: str, mode: str, digits: int | None = None) -> Query:
    def run(spark, sf_dir):
        out = LinkageEngine(VIEWS[view].config, mode).link(*_sides(spark, sf_dir, view))
        if digits is not None:
            out = out.withColumns({c: F.round(c, digits) for c in ("sum_field_weights", "sum_weights")})
        return out

    return run


for _name, _view, _mode, _digits in (
    ("link_int8", "person", "int8", None), ("link_int16", "person", "int16", None), ("link_int32", "person", INT32, None),
    ("link_int64", "swap", "int64", None), ("link_exact", "vec", "exact", 9), ("link_with_groups", "swap", INT32, None), ("link_documents", "doc", INT32, None),
):
    query(twin.link_sql(VIEWS[_view], _mode, _digits), _name)(_link(_view, _mode, _digits))


@query(f"SELECT record_idx, best_id, match, tentative_match FROM ({twin.link_sql(VIEWS['vec'], INT32)})")
def link_with_ids(spark, sf_dir):
    return _link("vec", INT32)(spark, sf_dir).select("record_idx", "best_id", "match", "tentative_match")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS record_idx, CAST(0 AS BIGINT) AS best_index, false AS match, false AS tentative_match, CAST(0 AS BIGINT) AS sum_weights FROM supplier")
def link_all_empty(spark, sf_dir):
    client, server = _sides(spark, sf_dir, "person")
    blank = client.select("record_idx", *[F.lit(None).cast("binary").alias(n) for n in _PERSON.config.names])
    return LinkageEngine(_PERSON.config).link(blank, server).select("record_idx", "best_index", "match", "tentative_match", "sum_weights")


@query(twin.count_sql(VIEWS["swap"], INT32))
def count_matches(spark, sf_dir):
    return LinkageEngine(VIEWS["swap"].config).count(*_sides(spark, sf_dir, "swap"))


@query(twin.count_sql(_PERSON, "exact"))
def count_exact(spark, sf_dir):
    return LinkageEngine(_PERSON.config, "exact").count(*_sides(spark, sf_dir, "person"))


# --- folds -----------------------------------------------------------------------------------

def _fold_sql(op: str) -> str:
    q = "CASE WHEN den = 0 THEN -1 ELSE (CAST(num AS HUGEINT) << 60) // den END"
    way = "DESC" if op.startswith("MAX") else "ASC"
    tie = f"den {way}, " if op.endswith("_TIE") else ""
    return f"""WITH {twin.scores_cte(VIEWS['swap'], _p('swap'))} SELECT record_idx, num, den, row_idx FROM
      (SELECT *, row_number() OVER (PARTITION BY record_idx ORDER BY {q} {way}, {tie}row_idx) AS rn FROM scores) WHERE rn = 1"""


def _fold(op: str) -> Query:
    def run(spark, sf_dir):
        return LinkageEngine(VIEWS["swap"].config).fold(*_sides(spark, sf_dir, "swap"), op)

    return run


for _op in fold.OPS:
    query(_fold_sql(_op), f"quotient_{_op.lower()}")(_fold(_op))


def _hw(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("bigint").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))


@query("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY l_suppkey")
def split_accumulate_sum(spark, sf_dir):
    return fold.accumulate(_hw(spark, sf_dir), "v", "sum", ["l_suppkey"])


@query("SELECT l_suppkey, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY l_suppkey")
def split_accumulate_max(spark, sf_dir):
    return fold.accumulate(_hw(spark, sf_dir), "v", "max", ["l_suppkey"])


@query("""SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS v, l_partkey FROM
  (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_orderkey * 10 + l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def select_target(spark, sf_dir):
    return fold.select_target(_hw(spark, sf_dir).withColumn("place", F.col("place").cast("decimal(30,0)") * 1000000 + F.col("l_partkey")), "v", "l_partkey", ["l_suppkey"], "place")


# --- sources, shares, statistics -----------------------------------------------------------------

@query("""SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, s_name AS id FROM supplier
UNION ALL SELECT (SELECT count(*) FROM supplier) + row_number() OVER (ORDER BY c_custkey) - 1, c_name FROM customer""")
def page_union(spark, sf_dir):
    first = fixtures._number(table(spark, sf_dir, "supplier"), "s_suppkey", "row_idx").select("row_idx", F.col("s_name").alias("id"))
    return union_pages(first, fixtures.person_server(spark, sf_dir).select("row_idx", "id"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS back, true AS hidden FROM orders")
def xor_share_roundtrip(spark, sf_dir):
    value = F.floor("o_totalprice").cast("bigint")
    a, b = shares.xor_split(value, 42, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", shares.xor_combine(a, b).alias("back"), ((a != value) | (b != value)).alias("hidden"))


_M = (1 << 32) - 1


@query(f"""SELECT l_orderkey, l_linenumber, (a * b) & {_M} AS prod, (a - b) & {_M} AS diff, CASE WHEN a > b THEN a ELSE b END AS larger,
  xor(a, b) AS exclusive, CAST(bit_count(a) AS BIGINT) AS ones, ((q << 8) + (n >> 1)) // n AS quotient
FROM (SELECT *, (l_partkey * 40503) & {_M} AS a, (l_orderkey * 65599) & {_M} AS b, CAST(l_quantity AS BIGINT) AS q, l_linenumber + 1 AS n FROM lineitem)""")
def share_algebra(spark, sf_dir):
    S = shares.Share
    a, b = S((F.col("l_partkey") * 40503).bitwiseAND(_M)), S((F.col("l_orderkey") * 65599).bitwiseAND(_M))
    q, n = S(F.col("l_quantity").cast("bigint")), S((F.col("l_linenumber") + 1).cast("bigint"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (a * b).col.alias("prod"), (a - b).col.alias("diff"), a.greater(b).mux(a, b).col.alias("larger"),
        (a ^ b).col.alias("exclusive"), a.hamming_weight().col.alias("ones"), q.divided(n, 8).col.alias("quotient"))


_MODES = ("int16", "int32", "int64", "exact")


def _table_sql() -> str:
    parts = [f"m_{m} AS ({twin.link_sql(VIEWS['swap'], m, 9 if m == 'exact' else None)})" for m in _MODES]
    cols = ", ".join(f"m_{m}.sum_field_weights AS num_{m}, m_{m}.sum_weights AS den_{m}" for m in _MODES)
    return f"WITH {', '.join(parts)} SELECT record_idx, {cols} FROM m_int16 " + " ".join(f"JOIN m_{m} USING (record_idx)" for m in _MODES[1:])


def _scores(spark, sf_dir):
    return score_table(VIEWS["swap"].config, *_sides(spark, sf_dir, "swap"), _MODES)


@query(_table_sql(), "score_table")
def _score_table(spark, sf_dir):
    return _scores(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("num_exact", "den_exact")})


def _dev_sql() -> str:
    out = []
    for m in _MODES[:3]:
        s, e = f"CAST(num_{m} AS DOUBLE) / CAST(nullif(den_{m}, 0) AS DOUBLE)", "num_exact / nullif(den_exact, 0)"
        dev = f"coalesce(({s} - {e}) / nullif({e}, 0) * 100, 0)"
        out.append(f"SELECT '{m}' AS mode, round(min({dev}), 6) AS min_dev, round(max({dev}), 6) AS max_dev, round(avg({dev}), 6) AS mean_dev FROM t")
    return f"WITH t AS ({_table_sql()}) " + " UNION ALL ".join(out)


@query(_dev_sql())
def precision_deviation(spark, sf_dir):
    got = stats.deviation_stats(stats.deviations(_scores(spark, sf_dir), list(_MODES[:3])), list(_MODES[:3]))
    return got.withColumns({c: F.round(c, 6) for c in ("min_dev", "max_dev", "mean_dev")})


@query("SELECT event_type, user_id, count(*) AS runs, round(avg(value), 6) AS value_mean, round(max(value), 6) AS value_max, round(coalesce(stddev_samp(value), 0), 6) AS value_stdev FROM events GROUP BY event_type, user_id")
def run_stats(spark, sf_dir):
    out = stats.run_stats(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["value"])
    return out.withColumns({c: F.round(c, 6) for c in ("value_mean", "value_max", "value_stdev")})


@query("""SELECT o_custkey, runs, price_mean, runs_2, price_max_2 FROM
  (SELECT o_custkey, count(*) AS runs, avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS price_mean FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) a JOIN
  (SELECT o_custkey, count(*) AS runs_2, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS price_max_2 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) b USING (o_custkey)""")
def run_join(spark, sf_dir):
    # Whole cents, whose sums are exact in any order.
    orders = table(spark, sf_dir, "orders").withColumn("price", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    a, b = (stats.run_stats(orders.filter(F.col("o_orderstatus") == s), ["o_custkey"], ["price"]) for s in ("O", "F"))
    return stats.join_runs([a, b], "o_custkey").select("o_custkey", "runs", "price_mean", "runs_2", "price_max_2")


@query("""SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def run_sort(spark, sf_dir):
    from pyspark.sql import Window

    runs = stats.run_stats(table(spark, sf_dir, "events"), ["event_type"], ["value"]).select("event_type", F.col("runs").alias("n"))
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("bigint")).orderBy("place")


@query("SELECT user_id, round(sum(value), 4) AS sent, round(sum(value * 2), 4) AS received, round(sum(value) + sum(value * 2), 4) AS comm FROM events GROUP BY user_id")
def run_communication(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("sent"), F.sum(F.col("value") * 2).alias("received"))
    t = stats.with_communication(t, "sent", "received", "comm")
    return t.select("user_id", *[F.round(c, 4).alias(c) for c in ("sent", "received", "comm")])


def entry(spark: SparkSession) -> DataFrame:
    return QUERIES["link_with_groups"](spark, "/root/testdata/sf0.001")
