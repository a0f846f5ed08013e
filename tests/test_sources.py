import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from kinlink.plans.config import FieldSpec, LinkageConfig
from kinlink.plans.engine import LinkageEngine, score_table
from kinlink.sources import http_pages, records, sinks

CONFIG = LinkageConfig.of([
    FieldSpec("mask", 0.01, 0.01, "dice", "bitmask", 16), FieldSpec("day", 0.03, 0.01, "binary", "integer", 5), FieldSpec("zip", 0.01, 0.04, "binary", "string", 40),
], 0.9, 0.6)


def b64(b):
    return base64.b64encode(b).decode()


def record(i, **more):
    return {"fields": {"mask": b64(bytes([i, 255 - i])), "day": i, "zip": f"1234{i}"} | more, "id": f"id-{i}"}


def page(k, last, recs, cursor="toDate"):
    return {"_links": {"self": {"href": "x"}}, "total": 99, "currentPageNumber": k, "lastPageNumber": last, "pageSize": 2, cursor: "2018", "localId": "a", "remoteId": "b", "records": recs}


PAGES = [page(1, 3, [record(1), record(2, zip="  ")]), page(2, 3, [record(3, day=None)], "todate"), page(3, 3, [record(4), record(5)])]


def write(tmp_path, pages):
    for k, p in enumerate(pages):
        (tmp_path / f"p{9 - k}.json").write_text(json.dumps([p] if k == 0 else p, indent=1))
    return str(tmp_path)


def test_pages_keep_ids_with_their_rows(spark, tmp_path):
    got = records.read_pages(spark, write(tmp_path, PAGES), CONFIG).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["id"]) for r in got] == [(i, f"id-{i + 1}") for i in range(5)]
    assert [bytes(r["mask"]) for r in got] == [bytes([i, 255 - i]) for i in range(1, 6)]
    assert got[1]["zip"] is None and got[2]["day"] is None and bytes(got[4]["zip"]) == b"12345"


@pytest.mark.parametrize("bad, what", [
    (lambda p: p.pop("records"), "records"), (lambda p: p.pop("localId"), "localId"), (lambda p: p["records"][0].pop("id"), "id"), (lambda p: p["records"][0].pop("fields"), "fields"),
    (lambda p: p["records"][0]["fields"].update(other=1), "unknown fields: other"), (lambda p: p["records"][0]["fields"].pop("zip"), "missing fields: zip"),
])
def test_broken_pages(spark, tmp_path, bad, what):
    p = page(1, 1, [record(1)])
    bad(p)
    with pytest.raises(Exception, match=what):
        records.read_pages(spark, write(tmp_path, [p]), CONFIG).collect()


def test_missing_as_null(spark, tmp_path):
    p = page(1, 1, [record(1)])
    del p["records"][0]["fields"]["zip"]
    assert records.read_pages(spark, write(tmp_path, [p]), CONFIG, "null").first()["zip"] is None


def test_requests(spark, tmp_path):
    one = {"callback": {"url": "u"}, "fields": record(1)["fields"]}
    many = {"callback": {"url": "u"}, "total": 2, "records": [{"fields": record(i)["fields"]} for i in (1, 2)]}
    for k, doc in enumerate((one, many, {"requests": [one, one, one]})):
        (tmp_path / "r.json").write_text(json.dumps(doc))
        from_file = records.read_requests(spark, str(tmp_path / "r.json"), CONFIG).orderBy("record_idx").collect()
        assert from_file == records.records_from_json(spark, doc, CONFIG).orderBy("record_idx").collect()
        assert [r["record_idx"] for r in from_file] == list(range(k + 1))
    with pytest.raises(ValueError):
        records.records_from_json(spark, {"x": 1}, CONFIG)


class Service(BaseHTTPRequestHandler):
    posted = []

    def do_GET(self):  # noqa: N802
        k = int(self.path.split("page=")[1].split("&")[0])
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps([PAGES[0]] if k == 1 else PAGES[k - 1]).encode())

    def do_POST(self):  # noqa: N802
        Service.posted.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        self.send_response(200)
        self.end_headers()
        self.wfile.write(b"ok")

    def log_message(self, *a):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_pages_and_result_posts(spark, tmp_path, service):
    got = http_pages.read_http(spark, f"{service}/db", CONFIG, page_size=2)
    want = records.read_pages(spark, write(tmp_path, PAGES), CONFIG)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    client = records.records_from_json(spark, {"records": [{"fields": record(i)["fields"]} for i in (4, 1)]}, CONFIG)
    links = LinkageEngine(CONFIG).link(client, want)
    assert [r["best_id"] for r in links.orderBy("record_idx").collect()] == ["id-4", "id-1"]
    doc = sinks.linkage_document(links, "server", want)
    assert sinks.send(doc, sinks.result_url(service, "a", "b")) == [(200, "ok")]
    path, body = Service.posted[-1]
    assert path == "/linkageResult/a/b" and body["role"] == "server" and body["ids"] == [f"id-{i}" for i in range(1, 6)]
    assert body["result"] == [{"match": True, "tentativeMatch": True, "bestIndex": i} for i in (3, 0)]
    counts = json.loads(sinks.count_document(LinkageEngine(CONFIG).count(client, want)).first()["document"])
    assert counts == {"result": {"matches": 2, "tentativeMatches": 2}}
    assert "ids" not in json.loads(sinks.linkage_document(links, "client").first()["document"])


def test_file_sinks(spark, tmp_path):
    server = records.read_pages(spark, write(tmp_path, PAGES), CONFIG)
    client = records.records_from_json(spark, {"fields": record(3)["fields"]}, CONFIG)
    sinks.write_results(LinkageEngine(CONFIG).link(client, server), str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert (row["best_index"], row["best_id"]) == (2, "id-3") and "sum_weights" not in row
    sinks.write_score_table(score_table(CONFIG, client, server), str(tmp_path / "table"))
    t = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "table"))
    assert t.columns == ["record_idx"] + [f"{x}_{m}" for m in ("int16", "int32", "int64", "exact") for x in ("num", "den")] and t.count() == 1
