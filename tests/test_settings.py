import json
import tomllib

import pytest
from kinlink.plans.engine import LinkageEngine
from kinlink.plans.settings import Settings, authorized, set_up_logging
from kinlink.sources.report import RunStatistics, result_report
from plain import frames
from test_engine import fixture


def test_sources_override_each_other(tmp_path):
    path = tmp_path / "conf.json"
    path.write_text(json.dumps({"defaultPageSize": 10, "useCircuitConversion": True, "mode": "int16"}))
    s = Settings.load(str(path), {"KINLINK_MODE": "int64", "KINLINK_LOG_FILES": "3"}, {"mode": "exact", "log_level": None})
    assert (s.default_page_size, s.use_circuit_conversion, s.mode, s.log_files, s.log_level) == (10, True, "exact", 3, "INFO")
    path.write_text('{"other": 1}')
    with pytest.raises(ValueError):
        Settings.load(str(path), {})


def test_keys_and_logs(tmp_path):
    assert authorized(Settings(), None)
    s = Settings(api_key="k", log_file=str(tmp_path / "log"))
    assert authorized(s, 'apiKey apiKey="k"') and not authorized(s, "k")
    set_up_logging(s, "test").warning("hello")
    assert "hello" in (tmp_path / "log").read_text()


def test_reports(spark):
    config, client, server, _ = fixture("mask")
    left, right = frames(spark, config, client, server)
    links = {m: LinkageEngine(config, m).link(left, right) for m in ("int32", "exact")}
    line = result_report(links["int32"], links["exact"]).first()["line"]
    assert line.startswith("record 0: best 0, match false, tentative false, score 0.66699") and line.endswith("%")
    stats, rows = RunStatistics.of({"dbSize": 3, "mode": "int32", "conversion": False}, lambda: links["int32"])
    doc = tomllib.loads(stats.to_toml())
    assert doc["parameters"] == {"dbSize": 3, "mode": "int32", "conversion": False} and doc["result"]["rows"] == len(rows) == 1
    assert set(doc["timing"]) == {"setup", "online"}
