"""Ranged archives as a source and as tables: what is read, in how many tasks, and how many bytes that takes."""

import http.server
import io
import random
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.sources import archives
from tests import archive_stub


def content(i):
    return random.Random(i).randbytes(3000) + b"text " * 200


@pytest.fixture
def folder(tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"a{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("d")
            for i in range(400):
                z.writestr(f"d/{'acc' if i % 50 < 2 else 'other'}_{i}.html", content(1000 * a + i), zipfile.ZIP_STORED if i % 7 == 0 else None)
    return tmp_path


@pytest.fixture
def pushing(spark):
    was = spark.conf.get(archives.PUSHDOWN, None)
    spark.conf.set(archives.PUSHDOWN, "true")
    yield spark
    spark.conf.set(archives.PUSHDOWN, was) if was else spark.conf.unset(archives.PUSHDOWN)


@pytest.mark.parametrize(("where", "names"), [
    ("startswith(name, 'd/acc_')", [f"d/acc_{i}.html" for i in range(400) if i % 50 < 2]), ("name = 'd/other_399.html'", ["d/other_399.html"]),
    ("name in ('d/acc_0.html', 'd/other_2.html', 'nowhere')", ["d/acc_0.html", "d/other_2.html"]), ("contains(name, 'acc_10') and endswith(name, '1.html') and size > 10", ["d/acc_101.html"]),
])
def test_filters_reach_the_index(pushing, folder, where, names):
    df = archives.archive(pushing, *(str(folder / f"a{a}.zip") for a in range(2)), opener="tests.archive_stub:counted", gap=2000, requests=2).where(where)
    parts = df.rdd.getNumPartitions()
    archive_stub.reads(folder)
    got = df.collect()
    assert sorted(r.name for r in got) == sorted(2 * names)
    assert all(bytes(r.content) == content(1000 * int(r.archive[-5]) + int(r.name.split("_")[1][:-5])) and r.size == len(r.content) for r in got)
    whole = sum((folder / f"a{a}.zip").stat().st_size for a in range(2))
    read = sum(n for _, n in archive_stub.reads(folder))
    index = 2 * 80_000  # each index, once more where the plan is made again
    assert parts == 2 * -(-len({int(n.split("_")[1][:-5]) // 50 for n in names}) // 2)
    assert read < 3 * index + 2 * len(names) * 4500 < whole


def test_without_pushdown(spark, folder):
    got = archives.archive(spark, str(folder / "a0.zip"), opener="tests.archive_stub:counted", most=100_000).where(F.col("name").contains("acc_"))
    assert got.rdd.getNumPartitions() > 8 and got.count() == 16


def test_tables(spark, folder):
    """A join picks the members; requests join neighbours, and bytes of the rest are not read."""
    paths = spark.createDataFrame([(str(folder / f"a{a}.zip"),) for a in (0, 1, 1)] + [(None,)], "archive string")
    index = archives.index(paths, "tests.archive_stub:counted")
    assert index.count() == 800
    wanted = spark.createDataFrame([(f"d/{'acc' if i % 50 < 2 else 'other'}_{i}.html",) for i in (0, 1, 2, 3, 50, 300, 399)], "name string")
    planned = archives.spans(index.join(wanted, "name"), gap=100).persist()
    assert planned.select("archive", "span").distinct().count() == 8
    archive_stub.reads(folder)
    got = archives.contents(planned, "tests.archive_stub:counted").collect()
    reads = archive_stub.reads(folder)
    planned.unpersist()
    assert len(got) == 14 and all(bytes(r.content) == content(1000 * int(r.archive[-5]) + int(r.name.split("_")[1][:-5])) for r in got)
    assert len(reads) == 8 and sum(n for _, n in reads) < 14 * 4500
    small = archives.spans(index, gap=10**9, most=50_000)
    assert small.groupBy("archive", "span").agg(F.sum(F.col("end") - F.col("offset")).alias("n")).agg(F.max("n")).first()[0] < 60_000
    assert archives.contents(archives.spans(index.where("false"))).count() == 0


def test_a_server_without_ranges(pushing, folder):
    got = archives.archive(pushing, str(folder / "a1.zip"), opener="tests.archive_stub:stubborn").where("endswith(name, '_7.html')").collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("d/other_7.html", content(1007))]


class Pipe(io.RawIOBase):
    """A file that cannot seek."""

    def __init__(self):
        self.out = io.BytesIO()

    def writable(self):
        return True

    def write(self, b):
        return self.out.write(b)


def test_streamed():
    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:  # sizes stand behind the members
        for i in range(30):
            z.writestr(f"é{i}", content(i))
        with z.open("large", "w", force_zip64=True) as f:
            f.write(content(5) * 300)
    data = pipe.out.getvalue()
    got = dict(archives.streamed(io.BytesIO(data), lambda n: n != "é3"))
    assert len(got) == 30 and got["é7"] == content(7) and got["large"] == content(5) * 300
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        with z.open("large", "w", force_zip64=True) as f:
            f.write(b"x" * 3_000_000)
        z.writestr("last", b"")
    assert dict(archives.streamed(io.BytesIO(plain.getvalue()), lambda n: True)) == {"large": b"x" * 3_000_000, "last": b""}
    for broken in (data[:50_000], b"<html>", bytes(b ^ (i == 2000) for i, b in enumerate(data))):
        with pytest.raises((ValueError, archives.zlib.error)):
            dict(archives.streamed(io.BytesIO(broken), lambda n: True))


def test_over_http(spark, folder):
    """Requests carry ranges, and a busy server is asked again."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str((folder / self.path[1:]).stat().st_size))
            self.end_headers()

        def do_GET(self):
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            seen.append(b - a + 1)
            if len(seen) == 2:
                self.send_response(503)
                self.end_headers()
                return
            part = (folder / self.path[1:]).read_bytes()[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        remote = archives.Http(f"http://127.0.0.1:{server.server_port}/a0.zip", archives.Patience(first=0.01))
        assert remote.size() == (folder / "a0.zip").stat().st_size and len(remote.read(0, 100)) == 100 and remote.read(5, 9) == (folder / "a0.zip").read_bytes()[5:9]
        got = archives.archive(spark, f"http://127.0.0.1:{server.server_port}/a1.zip", most=300_000)
        assert got.agg(F.sum(F.length("content"))).first()[0] == sum(len(content(1000 + i)) for i in range(400))
    finally:
        server.shutdown()
