"""Results as JSON documents, callbacks and score tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_rows(links: DataFrame) -> DataFrame:
    """record_idx and the JSON of one result; sums stay inside."""
    doc = F.to_json(F.struct(F.col("match"), F.col("tentative_match").alias("tentativeMatch"), F.col("best_index").alias("bestIndex")), {"ignoreNullFields": "false"})
    return links.select("record_idx", doc.alias("result"))


def linkage_document(links: DataFrame, role: str, server: DataFrame | None = None) -> DataFrame:
    """One row: the document for the linkage service, with ids for the server's role.

    A document is one value by its nature, and so is made in one task; use
    ``result_rows`` and a file sink for very many records.
    """
    rows = result_rows(links).select(F.struct("record_idx", "result").alias("r"))
    doc = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["result"]), ",").alias("results"))
    if role == "server":
        if server is None:
            raise ValueError("the server's document needs its ids")
        ids = server.select(F.struct("row_idx", "id").alias("r")).agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["id"])).alias("ids"))
        doc = doc.crossJoin(ids)
        return doc.select(F.concat(F.lit('{"role":"server","result":['), "results", F.lit('],"ids":'), "ids", F.lit("}")).alias("document"))
    return doc.select(F.concat(F.lit(f'{{"role":"{role}","result":['), "results", F.lit("]}")).alias("document"))


def count_document(counts: DataFrame) -> DataFrame:
    return counts.select(F.to_json(F.struct(F.struct("matches", F.col("tentative_matches").alias("tentativeMatches")).alias("result"))).alias("document"))


def result_url(service: str, local_id: str, remote_id: str) -> str:
    return f"{service.rstrip('/')}/linkageResult/{local_id}/{remote_id}"


def post(url: str, document: str, authorization: str | None = None, timeout: float = 15.0) -> tuple[int, str]:
    headers = {"Content-Type": "application/json"} | ({"Authorization": authorization} if authorization else {})
    with urlopen(Request(url, data=document.encode(), headers=headers, method="POST"), timeout=timeout) as answer:  # noqa: S310
        return answer.status, answer.read().decode()


def send(documents: DataFrame, url: str, sender: Callable[[str, str], object] = post) -> list[object]:
    """Hand the (few) documents to a sender from the driver."""
    return [sender(url, r["document"]) for r in documents.collect()]


def write_results(links: DataFrame, path: str) -> None:
    links.select("record_idx", "best_index", "best_id", "match", "tentative_match").write.mode("overwrite").json(path)


def write_score_table(table: DataFrame, path: str) -> None:
    """Semicolon-separated numerators and denominators of all modes, with a header."""
    order = [f"{x}_{m}" for m in ("int16", "int32", "int64", "exact") for x in ("num", "den") if f"{x}_{m}" in table.columns]
    table.select("record_idx", *order).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def read_document(row: str) -> dict:
    return json.loads(row)
