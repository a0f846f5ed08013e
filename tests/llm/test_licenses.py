from pathlib import Path

import pytest
from duck import assert_same
from kinlink.llm import licenses


def test_equals_sql(spark, sf_dir):
    assert_same(licenses.op6_license_scan(spark, sf_dir), licenses.scan_sql(), sf_dir)


def test_variants_of_a_text_are_one_licence(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT")
    texts = [
        "Copyright (c) 2019 Some Body\n\n" + mit.upper(),
        "© 2001-2004 A. N. Other\n" + mit.replace(", ", " ,\n  ").replace('"', "“"),
        mit + "\nBut you must also dance.",
        None, "", "Intro.\nReleased under the mit LICENCE\nmore",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [rows[i]["license_id"] for i in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert rows[3]["text_digest"] is None and rows[3]["n_license_lines"] == 0
    assert (rows[5]["line_licenses"], rows[5]["n_license_lines"]) == ("MIT", 1)


def test_whole_files_are_known(spark):
    home = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    files = {n: (home / n).read_text() for n in want if (home / n).exists()}
    if not files:
        pytest.skip("no licence files on this machine")
    rows = []
    for n, t in files.items():
        rows += [(want[n], t), (want[n], t.upper().replace("\n", "\r\n")), (want[n], "Copyright (c) 2020 Some Body\n\n" + t), (None, t + "\nOne more condition.")]
        if "END OF TERMS AND CONDITIONS" in t:
            rows.append((want[n], t[:t.index("END OF TERMS AND CONDITIONS")]))
    df = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(rows)], "doc_id bigint, want string, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["want"] for r in got)


def test_odd_rows(odd, none, sf_dir):
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(none).count() == 0
    docs = odd.select("doc_id", "text").toPandas()
    docs["doc_id"] = docs["doc_id"].astype("Int64")
    assert_same(licenses.scan(odd.select("doc_id", "text")).drop("text"), licenses.scan_sql("docs"), sf_dir, docs=docs)
