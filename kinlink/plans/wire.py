"""Queries of what surrounds the linkage: pages, requests, sinks, jobs, helpers, shares.

As in ``catalog``, each has its DuckDB twin.  Documents are written to the shared
folder, or served by a small HTTP server of the driver, and read back by the sources.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import codec, compare, containers, shares
from kinlink.operators import fold, score, stats
from kinlink.plans import fixtures, twin
from kinlink.plans.config import FieldSpec, LinkageConfig, RemoteParty, bitbytes
from kinlink.plans.engine import LinkageEngine
from kinlink.plans.facade import LinkageSession
from kinlink.plans.fixtures import VIEWS, table
from kinlink.plans.precision import Precision, ceil_log2, ceil_log2_min1, half_away, hw_size
from kinlink.plans.register import query
from kinlink.plans.settings import Settings, authorized
from kinlink.sources import records, report, sinks
from kinlink.sources.http_pages import PAGE_SIZE, read_http
from kinlink.sources.serve import PageServer
from kinlink.sources.shared import shared_dir
from kinlink.sources.synth import RandomInput, person_config
from kinlink.streaming.ingest import link_stream
from kinlink.streaming.jobs import LinkageService

INT32 = "int32"
PERSON, PERSON_VIEW = VIEWS["person"].config, VIEWS["person"]

#: Records as they travel: a mask in Base64, numbers and strings as JSON values.
WIRE = LinkageConfig.of([
    FieldSpec("mask", 0.01, 0.01, "dice", "bitmask", 13), FieldSpec("nation", 0.04, 0.01, "binary", "integer", 5),
    FieldSpec("balance", 0.01, 0.05, "binary", "integer", 24), FieldSpec("name", 0.001, 0.02, "binary", "string", 96),
], 0.9, 0.7)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return PERSON_VIEW.client(spark, sf_dir), PERSON_VIEW.server(spark, sf_dir)


def _fields(key: str, name: str, nation: str, balance: str) -> Column:
    """The JSON values of a record; every third has a blank name, every fifth no balance."""
    mask = F.base64(F.encode(F.substring(F.col(name), -2, 2), "UTF-8"))
    return F.struct(mask.alias("mask"), F.col(nation).alias("nation"), F.when(F.col(key) % 5 != 1, F.floor(F.col(balance))).alias("balance"),
                    F.when(F.col(key) % 3 == 1, F.lit("  \t")).otherwise(F.col(name)).alias("name"))


def _hexed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[F.hex(n).alias(n) for n in WIRE.names])


def _fields_sql(key: str, name: str, nation: str, balance: str) -> str:
    k = f"CAST(floor({balance}) AS BIGINT)"
    return f"""hex(encode(left(right({name}, 2), 1))) || printf('%02X', ascii(right({name}, 1)) & 31) AS mask,
      printf('%02X', {nation} & 255) AS nation,
      CASE WHEN {key} % 5 <> 1 THEN printf('%02X%02X%02X', {k} & 255, ({k} >> 8) & 255, ({k} >> 16) & 255) END AS balance,
      CASE WHEN {key} % 3 <> 1 THEN hex(encode(left({name}, 12))) || repeat('00', 12 - length(left({name}, 12))) END AS name"""


def _json(df: DataFrame, path: str) -> None:
    """Each row's ``value`` as a file of its own."""
    df.write.partitionBy("part").text(path)


# --- sources ---------------------------------------------------------------------------------

@query(f"SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, s_name AS id, {_fields_sql('s_suppkey', 's_name', 's_nationkey', 's_acctbal')} FROM supplier")
def read_page_files(spark, sf_dir):
    """The suppliers written as JSON pages of the default size, every other one in an array, and read back."""
    t = fixtures._number(table(spark, sf_dir, "supplier"), "s_suppkey", "i")
    n = t.count()
    rec = F.struct("i", F.col("s_name").alias("id"), _fields("s_suppkey", "s_name", "s_nationkey", "s_acctbal").alias("fields"))
    pages = t.select(F.expr(f"i div {PAGE_SIZE} + 1").alias("part"), rec.alias("r")).groupBy("part").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    records_ = F.transform("rs", lambda r: F.struct(r["id"].alias("id"), r["fields"].alias("fields")))
    page = F.struct(F.lit("a").alias("localId"), F.lit("b").alias("remoteId"), F.col("part").alias("currentPageNumber"), F.lit(-(-n // PAGE_SIZE)).alias("lastPageNumber"), records_.alias("records"))
    text = F.to_json(page, {"ignoreNullFields": "false"})
    path = shared_dir(spark, "pages")
    _json(pages.select("part", F.when(F.col("part") % 2 == 0, text).otherwise(F.concat(F.lit("["), text, F.lit("]"))).alias("value")), path)
    return _hexed(records.read_pages(spark, path, WIRE), "row_idx", "id")


def _nations(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The nations as records; a table of fixed size (25 rows)."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", _fields("n_nationkey", "n_name", "n_nationkey", "n_regionkey").alias("f"))
    rows = t.orderBy("n_nationkey").select("n_name", F.to_json("f", {"ignoreNullFields": "false"}).alias("f")).limit(25).collect()
    return [{"id": r["n_name"], "fields": json.loads(r["f"])} for r in rows]


_NATION_FIELDS = _fields_sql("n_nationkey", "n_name", "n_nationkey", "n_regionkey")


@query(f"""SELECT form, row_number() OVER (PARTITION BY form ORDER BY n_nationkey) - 1 AS record_idx, {_NATION_FIELDS} FROM nation,
  (VALUES ('records'), ('requests'), ('body'), ('fields')) v(form) WHERE form <> 'fields' OR n_nationkey = 7""")
def read_requests(spark, sf_dir):
    """Requests of one record, of many, of many requests, and a request's body."""
    nations = _nations(spark, sf_dir)
    docs = {"fields": {"fields": nations[7]["fields"]}, "records": {"records": nations}, "requests": {"requests": nations}}
    out = _hexed(records.records_from_json(spark, {"records": nations}, WIRE).withColumn("form", F.lit("body")), "form", "record_idx")
    for form, doc in docs.items():
        path = shared_dir(spark, "request")
        _json(spark.createDataFrame([(1, json.dumps(doc))], "part int, value string"), path)
        out = out.union(_hexed(records.read_requests(spark, path, WIRE).withColumn("form", F.lit(form)), "form", "record_idx"))
    return out


@query(f"""SELECT links, row_number() OVER (PARTITION BY links ORDER BY n_nationkey) - 1 AS row_idx, n_name AS id, {_NATION_FIELDS}
  FROM nation, (VALUES ('numbers'), ('cursors')) v(links)""")
def paged_http(spark, sf_dir):
    """The nations from a paged service, by links with page numbers and by links with cursors."""
    host, out = spark.conf.get("spark.driver.host", "127.0.0.1"), None
    for links in ("numbers", "cursors"):
        server = PageServer(_nations(spark, sf_dir), host, cursors=links == "cursors")
        got = _hexed(read_http(spark, f"{server.url}/records", WIRE, page_size=7).withColumn("links", F.lit(links)), "links", "row_idx", "id")
        server.close()  # the snapshot is read
        out = got if out is None else out.union(got)
    return out


def _synth_sql() -> str:
    """The generator's values from md5 alone, as hexadecimal digits."""
    config = person_config()

    def text(what: str, idx: str) -> str:
        return f"md5('73|{what}|' || {idx})"

    def value(spec: FieldSpec, what: str, idx: str) -> str:
        if spec.comparator == "dice":
            whole = " || ".join(text(f"{what}.{spec.name}.{k}", idx) for k in range(-(-spec.nbytes // 16)))
            head = f"upper(substr({whole}, 1, {2 * spec.nbytes - 2}))"  # the last byte keeps its low half
            return f"{head} || '0' || upper(substr({whole}, {2 * spec.nbytes}, 1))"
        number = f"(CAST('0x' || substr({text(f'{what}.{spec.name}', idx)}, 1, 15) AS BIGINT) % {1 << min(spec.bitsize, 32)})"
        return " || ".join(f"printf('%02X', ({number} >> {8 * i}) & 255)" for i in range(spec.nbytes))

    def uniform(what: str, idx: str) -> str:
        return f"(CAST('0x' || substr({text(what, idx)}, 1, 15) AS BIGINT) % {1 << 30}) / CAST({1 << 30} AS DOUBLE)"

    client, server = [], []
    for n, s in config.fields.items():
        client.append(f"{'NULL' if n == 'ort' else value(s, 'client', 'i')} AS {n}")
        own = value(s, "server", "i")
        if s.comparator == "binary" and n != "ort":
            own = f"CASE WHEN {uniform(f'copy.{n}', 'i')} < 0.5 THEN {value(s, 'client', '(i % n)')} ELSE {own} END"
        server.append(f"CASE WHEN {uniform(f'empty.{n}', 'i')} >= 0.2 THEN {own} END AS {n}")
    return f"""WITH k AS (SELECT greatest(1, count(*) // 10) AS n, count(*) AS d FROM customer),
    c AS (SELECT unnest(range(n)) AS i, n FROM k), s AS (SELECT unnest(range(d)) AS i, n FROM k)
    SELECT 'client' AS side, i AS idx, {', '.join(client)} FROM c UNION ALL SELECT 'server', i, {', '.join(server)} FROM s"""


@query(_synth_sql())
def synthetic_input(spark, sf_dir):
    """Random persons: a record for every tenth customer, a row for each."""
    n = table(spark, sf_dir, "customer").count()
    config = person_config()
    client, server = RandomInput(config, forced_empty=("ort",)).generate(spark, n, max(1, n // 10))
    text = [F.hex(c).alias(c) for c in config.names]
    return client.select(F.lit("client").alias("side"), F.col("record_idx").alias("idx"), *text).unionByName(server.select(F.lit("server").alias("side"), F.col("row_idx").alias("idx"), *text))


def _word_sql(name: str) -> str:
    return f"CAST('0x' || substr(md5('73|{name}|' || (c_custkey)), 1, 16) AS UBIGINT)"


@query(f"""SELECT c_custkey AS i, printf('%016X', {_word_sql('x.m.0')} | {_word_sql('x.m.0+0')}) AS dense, printf('%016X', {_word_sql('x.m.0')} & {_word_sql('x.m.0+0')} & {_word_sql('x.m.0+1')}) AS sparse FROM customer""")
def random_masks(spark, sf_dir):
    """Masks with more and with fewer ones."""
    spec = FieldSpec("m", 0.01, 0.01, "dice", "bitmask", 64)
    config = LinkageConfig.of([spec], 0.9, 0.7)
    mask = lambda density: F.hex(RandomInput(config, density=density)._mask(spec, "x", F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), mask(1).alias("dense"), mask(-2).alias("sparse"))


# --- sinks and jobs ----------------------------------------------------------------------------

_LINK = twin.link_sql(PERSON_VIEW, INT32)
_RESULT_SQL = """'{"role":"' || role || '","result":[' || (SELECT string_agg('{"match":' || match || ',"tentativeMatch":' || tentative_match || ',"bestIndex":' || best_index || '}', ',' ORDER BY record_idx) FROM links) || ']'"""


@query(f"""WITH links AS ({_LINK}), r AS ({PERSON_VIEW.server_sql})
SELECT role, {_RESULT_SQL} || CASE WHEN role = 'server' THEN ',"ids":[' || (SELECT string_agg('"' || id || '"', ',' ORDER BY row_idx) FROM r) || ']' ELSE '' END || '}}' AS document
FROM (VALUES ('client'), ('server')) v(role)""")
def linkage_document(spark, sf_dir):
    """The documents for the linkage service, of either role."""
    client, server = _sides(spark, sf_dir)
    links = LinkageEngine(PERSON).link(client, server)
    both = [sinks.linkage_document(links, role, server).select(F.lit(role).alias("role"), "document") for role in ("client", "server")]
    return both[0].union(both[1])


@query(f"""WITH links AS ({_LINK}), c AS ({twin.count_sql(PERSON_VIEW, INT32)})
SELECT 'link' AS kind, '/linkageResult/a/b' AS path, {_RESULT_SQL.replace("|| role ||", "|| 'client' ||")} || '}}' AS body
UNION ALL SELECT 'count', '/count', '{{"result":{{"matches":' || matches || ',"tentativeMatches":' || tentative_matches || '}}}}' FROM c""")
def callbacks(spark, sf_dir):
    """What a linkage service and a callback are sent."""
    client, server = _sides(spark, sf_dir)
    box = PageServer([])
    sinks.send(sinks.linkage_document(LinkageEngine(PERSON).link(client, server), "client"), sinks.result_url(box.url, "a", "b"))
    sinks.send(sinks.count_document(LinkageEngine(PERSON).count(client, server)), f"{box.url}/count")
    box.close()
    return spark.createDataFrame([(kind, *got) for kind, got in zip(("link", "count"), box.posted)], "kind string, path string, body string")


@query(f"SELECT record_idx, best_index, best_id, match, tentative_match FROM ({_LINK})")
def result_files(spark, sf_dir):
    """Results written as JSON lines, without the sums, and read back."""
    path = shared_dir(spark, "results")
    sinks.write_results(LinkageEngine(PERSON).link(*_sides(spark, sf_dir)), path)
    return spark.read.schema("record_idx bigint, best_index bigint, best_id string, match boolean, tentative_match boolean").json(path)


_SCORE_SQL = "coalesce(CAST(l.sum_field_weights AS DOUBLE) / CAST(nullif(l.sum_weights, 0) AS DOUBLE), 0)"
_EXACT_SQL = "(e.sum_field_weights / nullif(e.sum_weights, 0))"


@query(f"""SELECT l.record_idx, 'record ' || l.record_idx || ': best ' || l.best_index || ', match ' || l.match || ', tentative ' || l.tentative_match ||
  printf(', score %.4f, deviation %.3f%%', {_SCORE_SQL}, coalesce(({_SCORE_SQL} - {_EXACT_SQL}) / nullif({_EXACT_SQL}, 0) * 100, 0)) AS line
FROM ({_LINK}) l JOIN ({twin.link_sql(PERSON_VIEW, 'exact')}) e USING (record_idx)""")
def result_report(spark, sf_dir):
    client, server = _sides(spark, sf_dir)
    links, exact = (LinkageEngine(PERSON, m).link(client, server) for m in (INT32, "exact"))
    return report.result_report(links, exact, digits=(4, 3))


@query("""SELECT unnest(['[parameters]', 'dbSize = ' || (SELECT count(*) FROM customer), 'mode = "int32"', 'conversion = false', '[timing]', '[resources]', '[result]',
  'rows = ' || (SELECT count(*) FROM supplier)]) AS line""")
def run_report(spark, sf_dir):
    """A run's TOML without what differs from run to run."""
    client, server = _sides(spark, sf_dir)
    run = report.RunStatistics.measured({"dbSize": server.count(), "mode": INT32, "conversion": False}, lambda: LinkageEngine(PERSON).link(client, server))
    lines = [x for x in run.to_toml().splitlines() if x and x.split(" = ")[0] not in (*run.seconds, *run.resources)]
    return spark.createDataFrame([(x,) for x in lines], "line string")


def _service(spark: SparkSession, sf_dir: str, role: str = "client") -> LinkageService:
    config = LinkageConfig.from_json(json.dumps(PERSON.to_json()))
    out = LinkageService(spark, config, lambda: PERSON_VIEW.server(spark, sf_dir), INT32, role)
    for name, allowed in (("one", True), ("two", False)):
        out.init_remote(RemoteParty.from_json(name, {"connectionProfile": {"url": f"http://{name}"}, "matchingAllowed": allowed}))
    return out


@query(f"SELECT 'done' AS status, record_idx, best_index, best_id, match, tentative_match, sum_field_weights, sum_weights FROM ({_LINK})")
def service_link(spark, sf_dir):
    """A linkage job against the polled database, to its end."""
    service = _service(spark, sf_dir)
    job = service.wait(service.submit_link("one", PERSON_VIEW.client(spark, sf_dir)))
    service.close()
    if job.error:
        raise RuntimeError(job.error)
    return job.result.select(F.lit(job.status.value).alias("status"), "*")


@query(f"""WITH c AS ({twin.count_sql(PERSON_VIEW, INT32)}), links AS ({_LINK}), r AS ({PERSON_VIEW.server_sql})
SELECT 'one' AS remote, 'count' AS kind, 'done' AS status, '{{"result":{{"matches":' || matches || ',"tentativeMatches":' || tentative_matches || '}}}}' AS said FROM c
UNION ALL SELECT 'two', 'link', 'done', {_RESULT_SQL.replace("|| role ||", "|| 'server' ||")} || ',"ids":[' || (SELECT string_agg('"' || id || '"', ',' ORDER BY row_idx) FROM r) || ']}}'
UNION ALL SELECT 'two', 'count', 'refused', NULL UNION ALL SELECT 'three', 'link', 'refused', NULL UNION ALL SELECT '', 'rows', CAST(count(*) AS VARCHAR), NULL FROM customer""")
def service_jobs(spark, sf_dir):
    """Jobs of several remotes: who may, what they say to callbacks, and their states."""
    service, said, out = _service(spark, sf_dir, "server"), {}, []
    out.append(("", "rows", str(service.poll_database()), None))
    client = PERSON_VIEW.client(spark, sf_dir)
    asked = [("one", "count", service.submit_count), ("two", "link", service.submit_link), ("two", "count", service.submit_count), ("three", "link", service.submit_link)]
    ids = {}
    for remote, kind, submit in asked:
        try:
            ids[submit(remote, client, lambda doc, key=(remote, kind): said.__setitem__(key, doc))] = remote, kind
        except (PermissionError, KeyError):
            out.append((remote, kind, "refused", None))
    for job_id, key in ids.items():
        service.wait(job_id)
        out.append((*key, service.jobs()[key[0]][job_id], said.get(key)))
    service.close()
    return spark.createDataFrame(out, "remote string, kind string, status string, said string")


@query("SELECT count(*) FILTER (WHERE c_custkey % 4 <> 1) AS at_first, count(*) FILTER (WHERE c_custkey % 4 = 1) AS added, CAST(0 AS BIGINT) AS added_again FROM customer")
def service_changes(spark, sf_dir):
    """What a database has gained since the last poll."""
    service, (_, server) = _service(spark, sf_dir), _sides(spark, sf_dir)
    key = F.substring_index("id", "#", -1).cast("bigint")
    found = []
    for rows in (server.filter(key % 4 != 1), server, server):
        service._load = lambda rows=rows: rows
        found.append(service.poll_changes())
    service.close()
    return spark.createDataFrame([tuple(found)], "at_first bigint, added bigint, added_again bigint")


@query("SELECT * FROM (VALUES ('same configuration', true), ('other threshold', false), ('other field', false), ('service answers', true), ('service is gone', false), ('no service', false)) v(what, ok)")
def service_tests(spark, sf_dir):
    """The tests of a remote: equal configurations, and whether its linkage service answers."""
    service, box = _service(spark, sf_dir), PageServer([])
    fields = list(PERSON.fields.values())
    others = [PERSON, LinkageConfig.of(fields, 0.81, 0.5), LinkageConfig.of(fields[1:], 0.8, 0.5)]
    found = [service.test_config(c) for c in others]
    for name, url in (("here", box.url), ("gone", "http://127.0.0.1:9"), ("none", None)):
        service.init_remote(RemoteParty(name, "u", url))
        found.append(service.ping(name, 2.0))
    box.close()
    service.close()
    names = ("same configuration", "other threshold", "other field", "service answers", "service is gone", "no service")
    return spark.createDataFrame(list(zip(names, found)), "what string, ok boolean")


@query(f"SELECT 'link' AS kind, record_idx, CAST(best_index AS BIGINT) AS a, CAST(match AS BIGINT) AS b FROM ({_LINK}) UNION ALL SELECT 'count', 0, matches, tentative_matches FROM ({twin.count_sql(PERSON_VIEW, INT32)})")
def session_runs(spark, sf_dir):
    """A session goes through its states, is reset and runs again."""
    client, server = _sides(spark, sf_dir)
    n, d = client.count(), server.count()
    session = LinkageSession(PERSON)
    session.build("link", n, d)
    session.set_inputs(client, server)
    links = session.run().select(F.lit("link").alias("kind"), "record_idx", F.col("best_index").alias("a"), F.col("match").cast("bigint").alias("b"))
    session.reset()
    session.build("count", n, d)
    session.set_inputs(client, server)
    return links.union(session.run().select(F.lit("count"), F.lit(0).cast("bigint"), "matches", "tentative_matches"))


@query(f"""WITH links AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, s_name AS id, s_suppkey FROM supplier)
SELECT row_idx AS record_idx, row_idx AS best_index, id AS best_id, true AS match FROM links WHERE s_suppkey % 3 <> 1""")
def request_stream(spark, sf_dir):
    """Every supplier with a name asks for itself, in a stream of request files."""
    t = fixtures._number(table(spark, sf_dir, "supplier"), "s_suppkey", "row_idx")
    fields = _fields("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    config = LinkageConfig.of([*[f for f in WIRE.fields.values() if f.name != "name"], FieldSpec("name", 0.0001, 0.0, "binary", "string", 144)], 0.9, 0.7)
    asked, found, checks = (shared_dir(spark, n) for n in ("asked", "found", "checks"))
    text = F.struct(*[fields[n].cast("string").alias(n) for n in WIRE.names])
    t.filter("s_suppkey % 3 <> 1").select(F.col("row_idx").alias("record_idx"), text.alias("fields")).write.option("ignoreNullFields", "false").json(asked)
    as_map = F.create_map(*[x for n in WIRE.names for x in (F.lit(n), fields[n].cast("string"))])
    server = t.select("row_idx", F.col("s_name").alias("id"), *records.decoded(as_map, config))
    run = link_stream(spark, asked, config, server, lambda links, batch: links.write.mode("overwrite").parquet(f"{found}/batch={batch}"), checks)
    run.processAllAvailable()
    run.stop()
    return spark.read.parquet(found).select("record_idx", "best_index", "best_id", "match")


# --- configuration ---------------------------------------------------------------------------

def _refused(what: str, make) -> tuple[str, bool]:
    try:
        make()
    except (ValueError, RuntimeError, NotImplementedError):
        return what, True
    return what, False


def _checks() -> dict:
    f = lambda name="a", comparator="dice", bits=16, kind="bitmask", freq=0.01: FieldSpec(name, freq, 0.01, comparator, kind, bits)
    of = lambda fields, groups=(): LinkageConfig.of(fields, 0.9, 0.7, groups)
    early = LinkageSession(PERSON)
    return {
        "unknown member": lambda: of([f()], [["a", "b"]]), "empty group": lambda: of([f()], [[]]), "two groups": lambda: of([f(), f("b")], [["a", "b"], ["b"]]),
        "mixed comparators": lambda: of([f(), f("b", "binary")], [["a", "b"]]), "mixed sizes": lambda: of([f(), f("b", bits=8)], [["a", "b"]]),
        "unknown comparator": lambda: f(comparator="nGram"), "negative weight": lambda: f(freq=0.995), "too many bytes": lambda: f(kind="integer", bits=40),
        "too few bits": lambda: Precision.ideal(8, 17), "precisions too wide": lambda: Precision.of("int16", PERSON, 9, 9), "run before build": early.run,
        "a good one": lambda: of([f(), f("b")], [["a", "b"]]),
    }


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(k != 'a good one').lower()})" for k in _checks()) + ") v(what, refused)")
def config_checks(spark, sf_dir):
    return spark.createDataFrame([_refused(k, f) for k, f in _checks().items()], "what string, refused boolean")


@query("SELECT * FROM (VALUES ('default', 25, 'INFO', false), ('environment', 30, 'INFO', false), ('arguments', 40, 'DEBUG', true)) v(given, page_size, log_level, allowed)")
def settings_order(spark, sf_dir):
    """Arguments go before the environment, which goes before the defaults; a key must be shown if set."""
    env = {"KINLINK_DEFAULT_PAGE_SIZE": "30", "KINLINK_API_KEY": "k"}
    rows = []
    for name, given, args, header in (("default", {}, {}, "x"), ("environment", env, {}, "k"), ("arguments", env, {"default_page_size": 40, "log_level": "DEBUG"}, 'apiKey apiKey="k"')):
        s = Settings.load(env=given, args=args)
        rows.append((name, s.default_page_size, s.log_level, bool(s.api_key) and authorized(s, header)))
    return spark.createDataFrame(rows, "given string, page_size int, log_level string, allowed boolean")


@query("""SELECT n, (n + 7) // 8 AS bytes, CAST(ceil(log2(n)) AS BIGINT) AS log2, CAST(greatest(1, ceil(log2(n))) AS BIGINT) AS log2_min1,
  CAST(greatest(1, ceil(log2(n + 1))) AS BIGINT) AS ones, CAST(round(n / 2.0) AS BIGINT) AS half FROM (SELECT unnest(range(1, 200)) AS n)""")
def whole_numbers(spark, sf_dir):
    rows = [(n, bitbytes(n), ceil_log2(n), ceil_log2_min1(n), hw_size(n), half_away(n / 2)) for n in range(1, 200)]
    return spark.createDataFrame(rows, "n bigint, bytes bigint, log2 bigint, log2_min1 bigint, ones bigint, half bigint")


# --- scalars and containers ----------------------------------------------------------------------

@query("""SELECT p_partkey, array_to_string(list_transform(range(length(p_brand)), lambda i: lpad(bin(ascii(substr(p_brand, CAST(i + 1 AS INTEGER), 1))), 8, '0')), ' ') AS bits FROM part""")
def print_bytes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", codec.bit_text(F.encode("p_brand", "UTF-8")).alias("bits"))


@query(r"""SELECT c_custkey, c_name AS both_ends, c_name || chr(11) || ' ' || chr(13) AS from_left, chr(9) || ' ' || chr(10) || c_name AS from_right FROM customer""")
def trim_text(spark, sf_dir):
    s = F.concat(F.lit("\t \n"), F.col("c_name"), F.lit("\x0b \r"))
    return table(spark, sf_dir, "customer").select("c_custkey", codec.trim(s).alias("both_ends"), codec.trim(s, "left").alias("from_left"), codec.trim(s, "right").alias("from_right"))


@query("""SELECT c_custkey, CAST(len(string_split(c_name, '#')) AS BIGINT) AS parts, string_split(c_name, '#')[-1] AS last, string_split('a.b..c.' || c_mktsegment, '.')[5] AS fifth, CAST(4 AS BIGINT) AS without_trailing FROM customer""")
def split_text(spark, sf_dir):
    dotted = containers.split_text(F.concat(F.lit("a.b..c."), "c_mktsegment"), ".")
    name = containers.split_text(F.col("c_name"), "#")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.size(name).cast("bigint").alias("parts"), F.element_at(name, -1).alias("last"), F.element_at(dotted, 5).alias("fifth"),
        F.size(containers.split_text(F.lit("a.b..c."), ".")).cast("bigint").alias("without_trailing"))


@query(r"""SELECT doc_id, CAST(len(ls) AS BIGINT) AS lines, md5(array_to_string(ls, '|')) AS digest FROM
  (SELECT doc_id, regexp_split_to_array(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)), '\r\n|\r|\n') AS ls FROM documents)""")
def text_lines(spark, sf_dir):
    """Documents with all three kinds of line ends."""
    mixed = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    lines = containers.text_lines(mixed)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.md5(F.array_join(lines, "|")).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey || ',' || l_suppkey || ',' || l_linenumber AS joined, l_partkey || ',' || l_suppkey || ',' || l_partkey || ',' || l_suppkey AS repeated,
  (l_partkey * 2) || ',' || (l_suppkey * 2) AS doubled, (l_linenumber = l_partkey OR l_linenumber = l_suppkey) AS has, 'a,b' AS keys, l_suppkey + 1 AS b_value, l_partkey - l_suppkey - l_linenumber AS folded FROM lineitem""")
def container_helpers(spark, sf_dir):
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    v, line = F.array("l_partkey", "l_suppkey"), F.col("l_linenumber").cast("bigint")
    m = containers.transform_map(F.create_map(F.lit("b"), F.col("l_suppkey"), F.lit("a"), F.col("l_partkey")), lambda x: x + 1)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text(containers.concat_vec(v, F.array(line))).alias("joined"), text(containers.repeat_vec(v, 2)).alias("repeated"),
        text(containers.transform_vec(v, lambda x: x * 2)).alias("doubled"), containers.contains(v, line).alias("has"), text(containers.map_keys(m)).alias("keys"),
        F.element_at(m, "b").alias("b_value"), containers.left_fold(F.concat(v, F.array(line)), lambda a, x: a - x).alias("folded"))


@query("SELECT count(*) AS ids, count(*) AS different, CAST(32 AS BIGINT) AS digits FROM customer")
def generated_ids(spark, sf_dir):
    """Ids for jobs: as many different ones as are asked for."""
    made = table(spark, sf_dir, "customer").select(F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("id"))
    return made.agg(F.count("id").alias("ids"), F.count_distinct("id").alias("different"), F.max(F.length("id")).cast("bigint").alias("digits"))


@query("SELECT c_custkey, c_name AS person_name, c_nationkey AS person_home_nation, c_mktsegment AS segment FROM customer")
def flatten_nested(spark, sf_dir):
    nested = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_nationkey").alias("nation")).alias("home")).alias("person"), F.col("c_mktsegment").alias("segment"))
    return stats.flatten(nested, "_")


@query("SELECT event_type, user_id, count(*) AS runs FROM events GROUP BY event_type, user_id")
def runs_by_group(spark, sf_dir):
    """Run statistics written to a folder for each type, and read back."""
    path = shared_dir(spark, "runs")
    stats.write_by_group(stats.run_stats(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["value"]).select("event_type", "user_id", "runs"), path, "event_type", "user_id")
    return spark.read.option("header", True).schema("user_id bigint, runs bigint, event_type string").csv(path).select("event_type", "user_id", "runs")


@query("""SELECT event_type, 'value' AS "value", count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS most FROM events GROUP BY event_type""")
def describe_runs(spark, sf_dir):
    got = stats.describe(table(spark, sf_dir, "events"), ["value"], ["event_type"])
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "stdev", "least", "q1", "median", "q3", "most")})


@query(f"""SELECT record_idx, round(CAST(sum_field_weights AS DOUBLE) / CAST(nullif(sum_weights, 0) AS DOUBLE), 9) AS score FROM ({_LINK})""")
def score_ratio(spark, sf_dir):
    links = LinkageEngine(PERSON).link(*_sides(spark, sf_dir))
    return links.select("record_idx", F.round(score.score(F.col("sum_field_weights"), F.col("sum_weights")), 9).alias("score"))


# --- quotients and shares ----------------------------------------------------------------------------

_Q = "CAST(l_quantity AS BIGINT)"


def _choose_sql(op: str) -> str:
    a, b = f"{_Q} * (l_suppkey % 7)", "(l_partkey % 50) * (l_linenumber + 1)"
    less = f"CASE WHEN (l_linenumber + 1) = 0 THEN (l_suppkey % 7) <> 0 WHEN (l_suppkey % 7) = 0 THEN false WHEN {a} = {b} THEN {'(l_linenumber + 1) < (l_suppkey % 7)' if op.endswith('_TIE') else 'false'} ELSE {a} < {b} END"
    more = f"CASE WHEN (l_suppkey % 7) = 0 THEN true WHEN {a} = {b} THEN {'(l_linenumber + 1) > (l_suppkey % 7)' if op.endswith('_TIE') else 'false'} ELSE {a} > {b} END"
    second = more if op.startswith("MIN") else less
    return f"CASE WHEN {second} THEN (l_partkey % 50) || '/' || (l_suppkey % 7) ELSE {_Q} || '/' || (l_linenumber + 1) END AS {op.lower()}"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(_choose_sql(op) for op in fold.OPS)} FROM lineitem")
def quotient_select(spark, sf_dir):
    """One of two quotients in each row."""
    first = F.col("l_quantity").cast("bigint"), (F.col("l_linenumber") + 1).cast("bigint")
    second = (F.col("l_partkey") % 50).cast("bigint"), (F.col("l_suppkey") % 7).cast("bigint")

    def chosen(op: str) -> Column:
        won = fold.select_quotient(op, first, second)
        return F.concat_ws("/", won["num"].cast("string"), won["den"].cast("string")).alias(op.lower())

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[chosen(op) for op in fold.OPS])


_M = (1 << 32) - 1
_AB = f"(SELECT *, (l_partkey * 40503) & {_M} AS a, (l_orderkey * 65599) & {_M} AS b FROM lineitem)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, a & b AS conj, a | b AS disj, {_M} - a AS neg, (a << 5) & {_M} AS up, a >> 7 AS down, CAST(a = b AS BIGINT) AS same, CAST(a < b AS BIGINT) AS below,
  (a + b) & {_M} AS plus, a & 255 AS low, (a + b + 77) & {_M} AS total, greatest(a, b, 77) AS largest, CAST(l_quantity AS BIGINT) << {Precision.of(INT32, PERSON).dice} AS scaled FROM {_AB}""")
def share_bits(spark, sf_dir):
    S = shares.Share
    a, b, k = S((F.col("l_partkey") * 40503).bitwiseAND(_M)), S((F.col("l_orderkey") * 65599).bitwiseAND(_M)), S.constant(77)
    out = {"conj": a & b, "disj": a | b, "neg": ~a, "up": a << 5, "down": a >> 7, "same": a.equals(b), "below": a.less(b), "plus": a + b, "low": a.resized(8), "total": shares.total(a, b, k), "largest": shares.largest(a, b, k)}
    scaled = compare.scale(F.col("l_quantity"), Precision.of(INT32, PERSON)).alias("scaled")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[s.col.alias(n) for n, s in out.items()], scaled)


@query("""SELECT vec_id, place, CAST(CASE WHEN place < 4 THEN label WHEN place < 9 THEN place - 4 ELSE vec_id END AS BIGINT) AS v, part FROM
  (SELECT vec_id, label, unnest(range(10)) AS place FROM embeddings) JOIN (SELECT unnest(range(10)) AS place, unnest(['0,1,2', '0,1,2', '0,1,2', '0,1,2', '0,1,2', '0,1,2', '0,1,2', '3,4', '3,4', '3,4']) AS part) USING (place)""")
def share_vectors(spark, sf_dir):
    """Vectors repeated, combined, split into parts and into single values."""
    label = shares.Share(F.col("label").cast("bigint"))
    whole = shares.vcombine(label.repeated(4), F.array(*[F.lit(k).cast("bigint") for k in range(5)]), F.array(F.col("vec_id").cast("bigint")))
    t = table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("v"))
    sizes = F.transform(shares.split_parts(F.transform(shares.split_parts(F.sequence(F.lit(0), F.lit(4)), 3), lambda p: F.array_join(p.cast("array<string>"), ",")), 1), lambda p: p[0])
    return shares.unrolled(t, "v", "place").select("vec_id", F.col("place").cast("bigint").alias("place"), "v", F.when(F.col("place") < 7, sizes[0]).otherwise(sizes[1]).alias("part"))


@query("SELECT vec_id, hex(CAST(CASE WHEN label % 2 = 1 THEN '\\xFF\\x1F' ELSE '\\x00\\x00' END AS BLOB)) AS bits FROM embeddings")
def repeat_bit(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.hex(codec.repeat_bit(F.col("label") % 2 == 1, 13)).alias("bits"))
