"""A small HTTP service for trials: database pages by links, and a box for posts."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit


class PageServer:
    """Serves ``records`` in pages and keeps what is posted, as (path, body).

    ``/records?pageSize=n`` is the first page; ``_links.next.href`` leads on, by the
    number of the page or, with ``cursors``, by names that can't be guessed.
    """

    def __init__(self, records: list[dict], host: str = "127.0.0.1", local_id: str = "a", remote_id: str = "b", cursors: bool = False):
        self.records, self.local_id, self.remote_id, self.cursors = records, local_id, remote_id, cursors
        self.posted: list[tuple[str, str]] = []
        self.asked: list[str] = []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):  # noqa: N802
                outer.asked.append(self.path)
                self._say(json.dumps(outer.page(self.path)) if self.path.startswith("/records") else "ok")

            def do_POST(self):  # noqa: N802
                outer.posted.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode()))
                self._say("ok")

            def _say(self, text: str) -> None:
                self.send_response(200)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *args):
                pass

        self._server = ThreadingHTTPServer((host, 0), Handler)
        self.url = f"http://{host}:{self._server.server_port}"
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def _href(self, k: int, size: int) -> str:
        at = f"cursor={hash_name(k)}" if self.cursors and k > 1 else f"page={k}"
        return f"{self.url}/records?{at}&pageSize={size}&toDate=7"

    def page(self, path: str) -> list[dict] | dict:
        given = parse_qs(urlsplit(path).query)
        size = int(given.get("pageSize", ["25"])[0])
        last = max(1, -(-len(self.records) // size))
        k = int(given["page"][0]) if "page" in given else 1
        if "cursor" in given:
            k = next(j for j in range(1, last + 1) if hash_name(j) == given["cursor"][0])
        links = {"self": k, "first": 1, "last": last} | ({"next": k + 1} if k < last else {})
        doc = {"_links": {n: {"href": self._href(j, size)} for n, j in links.items()}, "currentPageNumber": k, "lastPageNumber": last, "pageSize": size,
               "toDate": 7, "localId": self.local_id, "remoteId": self.remote_id, "records": self.records[(k - 1) * size:k * size]}
        return [doc] if k == 1 else doc

    def close(self) -> None:
        self._server.shutdown()


def hash_name(k: int) -> str:
    return f"c{(k * 2654435761) % (1 << 32):08x}"
