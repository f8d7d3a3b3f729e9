import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from postmill import schemas
from postmill.operators.embed import word_counts
from postmill.plans.service import PostingService, as_json
from postmill.sources.embedding_api import ServiceError, http_embedder


class Handler(BaseHTTPRequestHandler):
    busy = 1

    def log_message(self, *args):
        pass

    def answer(self, status, body):
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path == "/g/acme":
            self.answer(200, {"jobs": [{"id": 1, "title": "Backend Engineer", "absolute_url": "u", "content": "&lt;p&gt;backend services&lt;/p&gt;"}]})
        elif self.path == "/old":
            self.send_response(302)
            self.send_header("Location", "/l")
            self.end_headers()
        elif self.path.startswith("/l"):
            self.answer(200, [{"id": "x", "text": "Sales", "hostedUrl": "u", "descriptionPlain": "sell things"}])
        else:
            self.answer(404, {})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.headers.get("X-Key") != "k":
            self.answer(403, {"error": "key"})
        elif Handler.busy:
            Handler.busy -= 1
            self.answer(429, {})
        else:
            self.answer(200, {"v": [[float(len(t))] for t in body["texts"]][: body.get("most", 99)]})


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_embedder(server):
    make = lambda key, **more: http_embedder(server, {"X-Key": key}, lambda texts, role: {"texts": texts, "role": role, **more}, lambda a: a["v"], wait=0.01)
    assert make("k")(["abc", "d"], "document").tolist() == [[3.0], [1.0]] and Handler.busy == 0
    with pytest.raises(ServiceError) as e:
        make("wrong")(["a"], "query")
    assert e.value.status == 403
    cut_off = http_embedder(server, {"X-Key": "k"}, lambda texts, role: {"texts": texts}, lambda a: a["v"], max_chars=4)
    assert cut_off(["abcdefg", "xy"], "document").tolist() == [[4.0], [2.0]]
    with pytest.raises(RuntimeError, match="1 embeddings for 2 texts"):
        make("k", most=1)(["a", "b"], "query")


def test_polling_and_documents(spark, server, tmp_path):
    s = PostingService(spark, str(tmp_path / "app"), word_counts)
    rows = [(5, "E", "GREENHOUSE", "acme", True, None, None), (1, "A", "GREENHOUSE", "acme", True, None, None), (2, "B", "LEVER", "b", True, None, None), (3, "C", "GREENHOUSE", "gone", True, None, None), (4, "D", "LEVER", "off", False, None, None)]
    s.company_table.write(spark.createDataFrame(rows, schemas.COMPANIES))
    run = s.ingest_boards({"GREENHOUSE": server + "/g/{token}", "LEVER": server + "/old"}, dt.datetime(2026, 1, 1)).head()
    assert (run.companies_polled, run.companies_failed, run.postings_new) == (3, 1, 3)
    errors = {r.id: r.last_poll_error for r in s.company_table.read().collect()}
    assert errors[1] is None and "404" in errors[3] and errors[4] is None
    (tmp_path / "cv.txt").write_text("I build backend services")
    assert s.match_document(str(tmp_path / "cv.txt"), 0).head().title == "Backend Engineer"
    (tmp_path / "empty.txt").write_text(" ")
    with pytest.raises(ValueError):
        s.match_document(str(tmp_path / "empty.txt"))
    first = json.loads(as_json(s.search(q="sales")).head()[0])
    assert first["title"] == "Sales" and first["canonical_id"] is None
