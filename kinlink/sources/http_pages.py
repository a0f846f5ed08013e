"""A paged HTTP database as a Spark data source.

``spark.dataSource.register(PagedHttp)``, then
``spark.read.format("paged_http").option("url", ...).load()`` gives rows
(page bigint, records array<struct<id string, fields map<string, string>>>).

The first page names the last one and links to the next.  Where that link only
differs in a page number, all pages are known at once: one partition each, fetched
by a task, and again if that task's executor is lost.  Other links (cursors, dates)
can only be followed page by page, which one task does, handing each page on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinlink.plans.config import LinkageConfig
from kinlink.sources.records import decoded, numbered_rows
from kinlink.sources.shared import shared_dir

PAGE_SIZE = 25
TIMEOUT_S = 15.0
NEEDED = ("localId", "remoteId", "_links", "records")


def fetch(url: str, auth: str | None = None, timeout: float = TIMEOUT_S) -> dict:
    headers = {"Accept": "application/json"} | ({"Authorization": auth} if auth else {})
    with urlopen(Request(url, headers=headers), timeout=timeout) as answer:  # noqa: S310
        doc = json.load(answer)
    return doc[0] if isinstance(doc, list) else doc


def href(page: dict, name: str) -> str | None:
    return (page.get("_links", {}).get(name) or {}).get("href")


def numbered(link: str, at: int, to: int) -> str | None:
    """``link`` to page ``at`` as a link to page ``to``; None if it holds no such number."""
    parts = urlsplit(link)
    given = parse_qsl(parts.query, keep_blank_values=True)
    if sum(k.lower() == "page" and v == str(at) for k, v in given) != 1:
        return None
    query = urlencode([(k, str(to) if k.lower() == "page" else v) for k, v in given])
    return urlunsplit(parts._replace(query=query))


class Pages(InputPartition):
    """A page by its link, or all pages from a link on."""

    def __init__(self, number: int, url: str, follow: bool = False):
        super().__init__(number)
        self.number, self.url, self.follow = number, url, follow


class PagedHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return "page bigint, records array<struct<id: string, fields: map<string, string>>>"

    def reader(self, schema):
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.auth = options["url"], options.get("authorization")
        self.size, self.timeout = int(options.get("pagesize", PAGE_SIZE)), float(options.get("timeout", TIMEOUT_S))

    def _first(self, number: int = 1) -> str:
        sep = "&" if "?" in self.url else "?"
        return f"{self.url}{sep}{urlencode({'page': number, 'pageSize': self.size})}"

    def _get(self, url: str) -> dict:
        doc = fetch(url, self.auth, self.timeout)
        for key in NEEDED:
            if key not in doc:
                raise RuntimeError(f"page at {url} lacks {key}")
        return doc

    def partitions(self):
        page = self._get(self._first())
        last, after = int(page.get("lastPageNumber", 1)), href(page, "next")
        if last <= 1:
            return [Pages(1, self._first())]
        if after is None:  # a service without links counts its pages
            return [Pages(k, self._first(k)) for k in range(1, last + 1)]
        after, end = urljoin(self.url, after), href(page, "last")
        pattern = numbered(after, 2, last)
        if pattern is None or end is not None and urljoin(self.url, end) != pattern:
            return [Pages(1, self._first(), follow=True)]
        return [Pages(1, self._first()), *[Pages(k, numbered(after, 2, k)) for k in range(2, last + 1)]]

    def _rows(self, number: int, page: dict) -> tuple:
        def text(v):
            return None if v is None else v if isinstance(v, str) else json.dumps(v)

        rows = []
        for r in page["records"]:
            if "fields" not in r or "id" not in r:
                raise RuntimeError(f"a record on page {number} lacks id or fields")
            rows.append((str(r["id"]), {k: text(v) for k, v in r["fields"].items()}))
        return number, rows

    def read(self, partition) -> Iterator[tuple]:
        number, page = partition.number, self._get(partition.url)
        yield self._rows(number, page)
        last = int(page.get("lastPageNumber", 1))
        while partition.follow and number < last:
            after = href(page, "next")
            if after is None:
                raise RuntimeError(f"page {number} of {last} has no link to the next")
            number, page = number + 1, self._get(urljoin(self.url, after))
            yield self._rows(number, page)


def read_http(spark: SparkSession, url: str, config: LinkageConfig, page_size: int = PAGE_SIZE, authorization: str | None = None, missing: str = "error", snapshot: bool = True) -> DataFrame:
    """A server database from a paged service.

    With ``snapshot`` each page is fetched once and kept in the shared folder, so that
    rows, numbers and ids of one run belong together even if the database moves on.
    """
    spark.dataSource.register(PagedHttp)
    load = spark.read.format("paged_http").option("url", url).option("pageSize", page_size)
    pages = (load.option("authorization", authorization) if authorization else load).load()
    if snapshot:
        path = shared_dir(spark, "pages")
        pages.write.parquet(path)
        pages = spark.read.parquet(path)
    rows = numbered_rows(pages)
    return rows.select("row_idx", "id", *decoded(rows["fields"], config, missing))
