"""Pages by links, jobs that are forgotten, sessions, report figures."""

import json

import pytest
from kinlink.functions import containers
from kinlink.plans.config import RemoteParty
from kinlink.plans.facade import LinkageSession
from kinlink.sources import http_pages, records, report
from kinlink.sources.serve import PageServer
from kinlink.streaming.jobs import LinkageService
from pyspark.sql import functions as F
from test_sources import CONFIG, record


@pytest.fixture
def rows():
    return [record(i) for i in range(1, 12)]


def test_links_are_followed(spark, rows):
    for cursors in (False, True):
        server = PageServer(rows, cursors=cursors)
        got = http_pages.read_http(spark, f"{server.url}/records", CONFIG, page_size=4)
        assert sorted((r["row_idx"], r["id"]) for r in got.collect()) == [(i, f"id-{i + 1}") for i in range(11)]
        asked = list(server.asked)
        # Snapshots: pages are fetched once (the first one also tells how many there are).
        got.count()
        assert server.asked == asked and len(asked) == 4
        assert sum("cursor=" in a for a in asked) == (2 if cursors else 0) and sum("toDate=7" in a for a in asked) == 2
        server.close()


def test_links_with_numbers():
    link = "http://h/r/all?page=2&pagesize=2&todate=15"
    assert http_pages.numbered(link, 2, 9) == "http://h/r/all?page=9&pagesize=2&todate=15"
    assert http_pages.numbered("http://h/r?cursor=2", 2, 9) is None
    assert http_pages.numbered("http://h/r?page=3", 2, 9) is None


def test_a_missing_link_is_an_error(spark, rows, monkeypatch):
    server = PageServer(rows, cursors=True)
    page = server.page

    def cut_off(path):
        doc = page(path)
        if isinstance(doc, dict):
            doc["_links"].pop("next", None)
        return doc

    monkeypatch.setattr(server, "page", cut_off)
    with pytest.raises(Exception, match="no link to the next"):
        http_pages.read_http(spark, f"{server.url}/records", CONFIG, page_size=4, snapshot=False).collect()
    server.close()


def test_jobs_are_forgotten_and_the_database_is_loaded_once(spark, rows):
    loads = []

    def load():
        loads.append(1)
        return records.records_from_json(spark, {"records": rows}, CONFIG).withColumnRenamed("record_idx", "row_idx").withColumn("id", F.col("row_idx").cast("string"))

    service = LinkageService(spark, CONFIG, load, role="server", keep=2)
    for k in range(3):
        service.init_remote(RemoteParty(f"r{k}", "u"))
    client, said = records.records_from_json(spark, {"fields": rows[3]["fields"]}, CONFIG), []
    ids = [service.submit_link(f"r{k % 3}", client, said.append) for k in range(5)]
    jobs = [service._jobs[i] for i in ids]
    for j in jobs:
        j.future.result(120)
        assert j.error is None
    assert len(loads) == 1 and sum(len(x) for x in service.jobs().values()) == 2
    assert json.loads(said[0])["ids"] == [str(i) for i in range(11)] and len(said) == 5
    assert service.poll_database() == 11 and len(loads) == 2
    service.close()


def test_session_states(spark, rows):
    client = records.records_from_json(spark, {"records": rows[:2]}, CONFIG)
    server = records.records_from_json(spark, {"records": rows}, CONFIG).withColumnRenamed("record_idx", "row_idx")
    session = LinkageSession(CONFIG)
    with pytest.raises(RuntimeError, match="created"):
        session.run()
    with pytest.raises(ValueError):
        session.build("other", 1, 1)
    session.build("count", 1, 11)
    with pytest.raises(RuntimeError, match="built for 1 records, got 2"):
        session.set_inputs(client, server)
    session.reset()
    session.build("link", 2, 11)
    session.set_inputs(client, server)
    assert sorted(r["best_index"] for r in session.run().collect()) == [0, 1]
    with pytest.raises(RuntimeError, match="done"):
        session.run()


def test_a_run_is_measured(spark):
    run = report.RunStatistics.measured({"n": 5}, lambda: spark.range(1000).repartition(3).selectExpr("id % 7 AS k").groupBy("k").count())
    assert run.rows == 7 and run.resources["exchanged_bytes"] > 0 and run.resources["cpu_seconds"] > 0


def test_folds_and_texts(spark):
    df = spark.createDataFrame([([5, 3, 1], "a,b,,"), ([4], ""), ([], ",")], "v array<bigint>, s string")
    got = df.select(containers.left_fold(F.col("v"), lambda a, x: a - x).alias("f"), containers.split_text(F.col("s"), ",").alias("p")).collect()
    assert [(r["f"], r["p"]) for r in got] == [(1, ["a", "b", ""]), (4, []), (None, [""])]
