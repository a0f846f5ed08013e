import json

import pytest
from kinlink.plans.config import RemoteParty
from kinlink.sources import records
from kinlink.streaming.ingest import link_stream
from kinlink.streaming.jobs import LinkageService
from test_sources import CONFIG, PAGES, record, write


def test_jobs(spark, tmp_path):
    path = write(tmp_path, PAGES)
    service = LinkageService(spark, CONFIG, lambda: records.read_pages(spark, path, CONFIG))
    service.init_remote(RemoteParty("r1", "u", matching_allowed=True))
    service.init_remote(RemoteParty("r2", "u"))
    with pytest.raises(NotImplementedError):
        service.init_remote(RemoteParty("r1", "u"))
    assert service.poll_database() == 5 and service.test_config(CONFIG)
    client = records.records_from_json(spark, {"fields": record(4)["fields"]}, CONFIG)
    said = []
    ids = [service.submit_link("r1", client, said.append), service.submit_count("r1", client, said.append), service.submit_link("r2", client)]
    jobs = [service.wait(i, 120) for i in ids]
    assert [service.job_status(i) for i in ids] == ["done"] * 3, jobs
    assert jobs[0].result.first()["best_id"] == "id-4"
    assert [json.loads(s)["result"] for s in said] == [[{"match": True, "tentativeMatch": True, "bestIndex": 3}], {"matches": 1, "tentativeMatches": 1}]
    with pytest.raises(PermissionError):
        service.submit_count("r2", client)
    with pytest.raises(KeyError):
        service.submit_link("r3", client)
    bad = service.submit_link("r2", client.drop("zip"))
    assert service.wait(bad, 60).error.startswith("ValueError") and service.job_status(bad) == "fault"
    assert set(service.jobs()) == {"r1", "r2"}
    service.close()


def test_stream_of_requests(spark, tmp_path):
    (tmp_path / "db").mkdir()
    (tmp_path / "in").mkdir()
    server = records.read_pages(spark, write(tmp_path / "db", PAGES), CONFIG)
    for k in (1, 5):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"record_idx": k, "fields": {n: None if v is None else str(v) for n, v in record(k)["fields"].items()}}))
    got = {}

    def sink(links, batch):
        got.update({r["record_idx"]: r["best_id"] for r in links.collect()})

    q = link_stream(spark, str(tmp_path / "in"), CONFIG, server, sink, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert got == {1: "id-1", 5: "id-5"}
