"""Fetching from a server on this machine and from files."""

import hashlib
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from driftwood.sources import fetch

SHA = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture
def server():
    asked = Counter()

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            ok = self.path in ("/good", "/large", "/wrong") or (self.path == "/flaky" and asked[self.path] > 2)
            self.send_response(200 if ok else 404 if self.path == "/gone" else 500)
            body = b"x" * 5000 if self.path == "/large" else b"body of " + self.path.encode()
            if self.path != "/large":
                self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_states_of_fetches_and_resuming(spark, server, tmp_path):
    base, asked = server
    (tmp_path / "file.txt").write_bytes(b"from a file")
    rows = [(f"{base}/good", SHA(b"body of /good").upper()), (f"{base}/flaky", None), (f"{base}/gone", None), (f"{base}/large", None), (f"{base}/wrong", SHA(b"other")), (f"{base}/down", None)]
    rows += [(f"file://{tmp_path}/file.txt", SHA(b"from a file")), (f"file://{tmp_path}/none.txt", None), ("no url", None), (None, None), (f"{base}/good", SHA(b"body of /good").upper())]
    requests = spark.createDataFrame(rows, "url string, sha256 string")
    out = {r.url: r for r in fetch.fetch_into(requests, f"{tmp_path}/states", most=1000, tries=3, wait=0.01).collect()}
    found = {u and u.rsplit("/", 1)[-1]: (r.status, r.tries, r.content and bytes(r.content)) for u, r in out.items() if u}
    assert found == {
        "good": ("ok", 1, b"body of /good"), "flaky": ("ok", 3, b"body of /flaky"), "gone": ("not_found", 1, None), "large": ("too_large", 1, None), "wrong": ("checksum_mismatch", 1, None), "down": ("failed", 3, None),
        "file.txt": ("ok", 1, b"from a file"), "none.txt": ("not_found", 1, None), "no url": ("failed", 3, None),
    }
    before = dict(asked)
    again = {r.url: r.status for r in fetch.fetch_into(requests, f"{tmp_path}/states", most=1000, tries=2, wait=0.01).collect()}
    assert {u: s for u, s in again.items() if u} == {u: r.status for u, r in out.items() if u}
    assert {p: asked[p] - before[p] for p in asked} == {p: 2 if p == "/down" else 0 for p in asked}
    assert fetch.fetched(requests.limit(0)).count() == 0
