"""Documents fetched in tasks, and shapes as tables."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import documents
from quarrystone.sources.patience import Patience


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        server, path = self.server, self.path
        server.seen.append((path, self.headers.get("Authorization")))
        if path.startswith("/go/"):
            self.send_response(302)
            self.send_header("Location", f"http://127.0.0.1:{server.other}/{path[4:]}")
            self.end_headers()
        elif path.startswith("/here/"):
            self.send_response(302)
            self.send_header("Location", f"/{path[6:]}")
            self.end_headers()
        elif path == "/busy" and sum(p == path for p, _ in server.seen) < 3 or path == "/down":
            self.send_response(503)
            self.end_headers()
        elif path == "/none":
            self.send_response(404)
            self.end_headers()
        else:
            body = f"content of {path}".encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def servers():
    made = [http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler) for _ in range(2)]
    for a, b in zip(made, reversed(made)):
        a.seen, a.other = [], b.server_port
        threading.Thread(target=a.serve_forever, daemon=True).start()
    yield made
    for a in made:
        a.shutdown()


def test_documents(spark, servers):
    a, b = servers
    at = lambda p: f"http://127.0.0.1:{a.server_port}{p}"
    rows = [(1, at("/x")), (2, at("/go/y")), (3, at("/here/z")), (4, at("/none")), (5, at("/busy")), (6, at("/down")), (7, None)]
    index = spark.createDataFrame(rows, "n int, url string")
    out = documents.fetched(index, "url", {"Authorization": "Basic secret"}, Patience(tries=3, first=0.01), lanes=2)
    assert out.columns == ["n", "url", "status", "content", "error"]
    got = {r.n: (r.status, bytes(r.content).decode() if r.content is not None else None, r.error and r.error.split(":")[0]) for r in out.collect()}
    assert got == {
        1: (200, "content of /x", None), 2: (200, "content of /y", None), 3: (200, "content of /z", None), 4: (404, None, "status 404"), 5: (200, "content of /busy", None), 6: (None, None, "http"), 7: (None, None, "no url"),
    }
    assert {s for _, s in a.seen} == {"Basic secret"}  # also where it leads to itself
    assert b.seen == [("/y", None)]  # another host learns nothing
    assert documents.fetched(index.where("false"), "url").count() == 0


def test_features(spark, tmp_path):
    shapes = [
        ("a", "Polygon", [[[0, 0], [2, 0], [2, 1], [0, 0]], [[0.5, 0.1], [0.6, 0.1], [0.5, 0.1]]]), ("b", "MultiPolygon", [[[[5, 5], [6, 5], [5, 5]]], [[[-7.5, 8], [9, 9], [-7.5, 8]]]]),
        ("c", "Point", [1.5, 2]), ("d", "LineString", [[0, 0], [1, 1]]),
    ]
    body = [{"type": "Feature", "properties": {"name": n, "code": i}, "geometry": {"type": k, "coordinates": c}} for i, (n, k, c) in enumerate(shapes)] + [{"type": "Feature", "properties": {"name": "e"}, "geometry": None}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": body}, indent=1))
    df = documents.bounds(documents.features(spark, str(tmp_path / "g.json"), "name: string, code: int"))
    got = {r.name: (r.code, r.kind, r.rings and [len(x) for x in r.rings], r.west, r.south, r.east, r.north) for r in df.collect()}
    assert got == {
        "a": (0, "Polygon", [4, 3], 0, 0, 2, 1), "b": (1, "MultiPolygon", [3, 3], -7.5, 5, 9, 9), "c": (2, "Point", [1], 1.5, 2, 1.5, 2), "d": (3, "LineString", [2], 0, 0, 1, 1), "e": (None, None, None, None, None, None, None),
    }
    assert df.where(F.col("name") == "b").select(F.col("rings")[1][0]["x"]).first()[0] == -7.5
