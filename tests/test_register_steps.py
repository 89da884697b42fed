import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone import session
from quarrystone.functions import classify
from quarrystone.operators import prediction, survival
from quarrystone.sources import cached, files, paged, patience
from tests import paged_stub

ROUTES = [
    (["LIQ01", "LIQ13"], "", "members_voluntary_liquidation"), (["LIQ01", "LIQ02"], "insolvency", "creditors_voluntary_liquidation"), (["600"], "", "creditors_voluntary_liquidation"),
    (["DS01", "wu01"], "", "compulsory_liquidation"), (["AM23", "LIQ01"], "", "administration"), (["X"], "Insolvency", "insolvency_other"), (["GAZ1", "GAZ1(A)"], "", "voluntary_strike_off"),
    (["GAZ1"], "", "registrar_strike_off"), (["GAZ12"], "", "unknown"), ([None], None, "unknown"),
]


def test_exit_routes(spark):
    rows = [(i, f, c) for i, (forms, c, _) in enumerate(ROUTES) for f in forms]
    got = {r.id: r.route for r in classify.exit_route(spark.createDataFrame(rows, "id int, form string, category string"), "id", "form", "category").collect()}
    assert got == {i: route for i, (_, _, route) in enumerate(ROUTES)}


def test_labels_and_features(spark):
    rows = [(1, 100, True), (2, 100, False), (3, 2000, True), (4, 1096, False), (5, -1, True), (6, 1095, None), (7, None, True)]
    got = {r.id: r.label for r in prediction.exit_labels(spark.createDataFrame(rows, "id int, days int, event boolean"), "days", "event").collect()}
    assert got == {1: 1, 3: 0, 4: 0}
    rows = [(1, -5.0, 1.0, 4.0, 9.0, 500), (2, 5.0, 1.0, 0.0, 9.0, 1), (3, None, 1.0, 4.0, 9.0, 1), (4, 5.0, 1.0, 4.0, None, 1), (5, 5.0, 2.0, 4.0, 1.0, None)]
    r = prediction.exit_features(spark.createDataFrame(rows, "id int, e double, c double, k double, l double, s int"), "e", "c", "k", "l", "s").collect()
    assert [(x.id, x.negative_equity, x.cash_share, x.negative_capital, round(x.log_staff, 4)) for x in r] == [(1, 1.0, 0.25, 1.0, 4.6151)]
    years = spark.createDataFrame([(y,) for y in (2017, 2018, 2021, 2022, 2023, None)], "y int")
    assert [x.part for x in prediction.by_year(years, "y", (2018, 2021), 2022).orderBy("y").collect()] == ["train", "train", "test"]


def test_stock_projection(spark):
    rows = spark.createDataFrame([("a", t, int(t % 3 == 0)) for t in range(10, 2200, 10)], "g string, duration int, event int")
    curve = survival.kaplan_meier(rows, ["g"])
    points = sorted((r.time, r.survival) for r in curve.collect())

    def s(d):
        return [1.0, *(v for t, v in points if t <= min(d, 1825))][-1]

    ages = [5, 5, 300, 1000, 1900]
    got = prediction.stock_projection(spark.createDataFrame([("a", x) for x in ages], "g string, age int"), spark.createDataFrame([("a", 40)], "g string, n int"), curve, "g")
    want = {(y, m): int(sum(s(d + 365 * y) / max(s(d), 1e-9) for d in ages) + m * sum(40 * s(365 * (y - j) - 182) for j in range(y))) for y in (1, 2, 3) for m in (0.9, 1.0, 1.1)}
    assert {(r.year, r.scenario): r.projected for r in got.collect()} == want
    grid = survival.sampled_curve(curve, ["g"])
    assert {r.horizon: r.survival for r in grid.collect()} == {d: s(d) for d in range(0, 1121, 10)}


class Service:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), 0

    def __call__(self, request, timeout):
        self.asked += 1
        x = self.answers.pop(0)
        if isinstance(x, bytes):
            return io.BytesIO(x)
        raise urllib.error.HTTPError("u", x, "no", {"Retry-After": "7"}, None)


def test_cached_service(tmp_path):
    slept, service = [], Service(429, 503, b'{"x": 1}', 404, 400)
    c = cached.CachedService("http://h", str(tmp_path), opener=service, sleep=slept.append)
    assert [c.get("/a", {"q": 1}) for _ in range(2)] == [{"x": 1}] * 2 and service.asked == 3 and slept == [7.0, 7.0]
    assert [c.get("/b") for _ in range(2)] == [None, None] and service.asked == 4
    with pytest.raises(patience.Refused):
        c.get("/c")
    with pytest.raises(patience.Unanswered):
        cached.CachedService("http://h", str(tmp_path), opener=Service(500, 500), sleep=slept.append, patience=patience.Patience(tries=2)).get("/d")
    assert cached.CachedService("http://h", str(tmp_path), opener=Service(b"{bro", b"[1]"), sleep=slept.append).get("/e") == [1]


def test_patience():
    p = patience.Patience(tries=6, first=2, growth=3, most=20, jitter=0.5)
    pauses = list(p.pauses("x"))
    assert pauses == list(p.pauses("x")) != list(p.pauses("y")) and len(pauses) == 5
    assert all(low <= x <= 1.5 * low for x, low in zip(pauses, (2, 6, 18, 20, 20)))
    reply = lambda **h: patience.Reply(429, {k.replace("_", "-"): v for k, v in h.items()})
    assert [p.asked(reply(Retry_After=x), 784111700.0) for x in ("12", "9999", "", "soon", "Sun, 06 Nov 1994 08:49:37 GMT")] == [12, 600, 0, 0, 77]
    assert [p.temporary(x) for x in (0, 200, 206, 400, 404, 408, 429, 500, 503)] == [True, False, False, False, False, True, True, True, True]


def test_lookups_and_downloads(tmp_path):
    calls = []

    def bulk(part):
        calls.append(len(part))
        return {k: {"v": k} for k in part if k != "k3"}

    keys = [f"k{i}" for i in range(150)] + ["gone", "k1"]
    for _ in range(2):
        got = cached.lookup_all(keys, str(tmp_path / "l.json"), lambda p: {k: v for k, v in bulk(p).items() if k != "gone"}, lambda k: {"old": k} if k == "gone" else None)
    assert calls == [100, 51] and got["gone"] == {"old": "gone"} and got["k3"] is None and got["k1"] == {"v": "k1"} and len(got) == 151
    assert [cached.downloaded("u", str(tmp_path / "f"), opener=Service(b"x")) for _ in range(2)] == [True, False]


def test_tables_that_may_not_be_there(spark, tmp_path):
    schema = StructType().add("x", "integer").add("y", "string")
    path = str(tmp_path / "t")
    assert session.optional_table(spark, path, schema).count() == 0
    session.replace_table(spark.range(3).select(F.col("id").alias("x"), F.lit(5).alias("y")), path, schema)
    t = session.optional_table(spark, path, schema)
    assert t.schema["y"].dataType.typeName() == "string" and t.count() == 3
    wider = session.with_columns_of(t, *schema.fields, StructType().add("z", "double")["z"])
    assert wider.columns == ["x", "y", "z"] and wider.where("z is null and y = '5'").count() == 3
    assert session.reset(spark, path) and not session.reset(spark, path)


def test_json_entries_and_charges(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"_note": "text", "a": {"n": 1}, "b": {"n": 2}}))
    assert sorted((r.key, r.item.n) for r in files.json_entries(spark, str(tmp_path / "v.json"), "n long").collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c/9.json").write_text(json.dumps([{"created_on": "2020-01-02", "status": "fully-satisfied"}, {"created_on": "2019-01-02", "status": "outstanding"}]))
    r = files.charges_summary(files.histories(spark, str(tmp_path / "c"), files.CHARGE)).first()
    assert (r.entity, r.charges, r.outstanding, r.satisfied, r.first_charge, r.last_charge) == ("9", 2, 1, 1, "2019-01-02", "2020-01-02")


def test_pack_and_unpack(tmp_path):
    (tmp_path / "h/in").mkdir(parents=True)
    for i in range(5):
        (tmp_path / f"h/in/{i}.json").write_text(str(i))
    assert files.pack(str(tmp_path / "h"), str(tmp_path / "h.zip")) == 5 and not (tmp_path / "h").exists()
    assert files.unpack(str(tmp_path / "h.zip"), str(tmp_path)) == 5 and (tmp_path / "h/in/3.json").read_text() == "3"


def test_paged_source_runs_in_spark(spark):
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(slices=json.dumps(["a", "b"]), service="tests.paged_stub:fetch").load()
    assert df.rdd.getNumPartitions() == 2
    assert {r.slice: r["count"] for r in df.groupBy("slice").count().collect()} == {"a": 250, "b": 250}


def test_slices_are_refined_in_the_cluster(spark, tmp_path):
    """A register of 20,000 entities, of which a query serves 5,000, is read whole."""
    seeds = spark.createDataFrame([(f"district=d{i}",) for i in range(7)] + [("district=d1",), (None,)], "query string")
    splits = [[f"kind=k{i}" for i in range(3)], [f"year=y{i}" for i in range(11)]]
    slices = paged.refined(seeds, splits, "tests.paged_stub:count", str(tmp_path / "levels"), cap=paged_stub.SERVED)
    rows = slices.collect()
    assert sorted({r.level for r in rows}) == [0, 1, 2] and not any(r.cut for r in rows) and len(rows) == 6 + 2 + 11
    assert sum(r.hits for r in rows) == 20_000
    slices.write.parquet(str(tmp_path / "slices"))
    spark.dataSource.register(paged.PagedSource)
    df = spark.read.format("paged").options(slices_at=str(tmp_path / "slices"), service="tests.paged_stub:search", lanes="4", size="1000", cap=str(paged_stub.SERVED)).load()
    assert df.rdd.getNumPartitions() == 4
    assert df.select(F.get_json_object("item", "$.n")).distinct().count() == df.count() == 20_000


def test_refinement_goes_on(spark, tmp_path):
    """A level that was written is not asked for again; a finest slice that the service cuts is told."""
    seeds = spark.createDataFrame([("district=d0",), ("district=d3",)], "query string")
    folder = str(tmp_path / "levels")
    first = paged.refined(seeds, [["kind=k0"]], "tests.paged_stub:count", folder, cap=5000).collect()
    assert {(r.query, r.level, r.cut) for r in first} == {("district=d3", 0, False), ("district=d0&kind=k0", 1, True)}
    again = paged.refined(seeds, [["kind=k0"]], "tests.nowhere:count", folder, cap=5000)
    assert sorted(again.collect()) == sorted(first)
    assert paged.refined(seeds.where("false"), [["kind=k0"]], "tests.paged_stub:count", str(tmp_path / "none")).count() == 0


def test_lanes_keep_to_one_rate():
    now, at = [1000.03], []

    def sleep(s):
        now[0] += s

    lanes = [paged.Lane(i, 3, 10.0, lambda: now[0], sleep) for i in range(3)]
    for _ in range(8):
        for lane in lanes:
            lane.wait()
            at.append(now[0])
    assert all(b - a > 0.0999 for a, b in zip(at, at[1:])) and at[-1] - at[0] < 2.4
    free = paged.Lane(0, 3, 0.0, lambda: now[0], lambda s: at.append(None))
    free.wait()
    assert at[-1] is not None
    hits = [("a", 900), ("b", 500), ("c", 450), ("d", 30), ("e", 0)]
    assert paged.dealt(hits, 2) == [["a", "d", "e"], ["b", "c"]] and paged.dealt([], 4) == [] and len(paged.dealt(hits, 9)) == 5
