"""Sectors, typed tables, establishments, filing indexes, lookups, result files, names in hot blocks."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone import session
from quarrystone.functions.normalise import company_name
from quarrystone.operators import linkage, stats
from quarrystone.plans import exports
from quarrystone.sources import files, registers


def test_typed_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b' b , a,c\n1, 2020-01-02 ,"x, y"\nz,2020-13-01,\xff\n,,\n')
    schema = StructType().add("a", "date").add("b", "integer").add("c", "string").add("d", "double")
    df = registers.typed_csv(spark, str(tmp_path / "t.csv"), schema)
    assert df.schema == schema and [(str(r.a), r.b, r.c, r.d) for r in df.collect()] == [("2020-01-02", 1, "x, y", None), ("None", None, "�", None), ("None", None, None, None)]


def test_sector_scan(spark, tmp_path):
    header = " CompanyNumber,CompanyStatus,IncorporationDate,RegAddress.PostCode,RegAddress.AddressLine1,RegAddress.AddressLine2,SICCode.SicText_1,SICCode.SicText_2\n"
    rows = ["1,Active,01/02/2020,n120nl,12 High Road,,56302 - Pubs,96020 - Hair", "2,Active,,N1 1AA,1 A Street,,99999 - x,96020 - y", "3,Active,,N1 1AA,1 A Street,,99999 - x,", "4,Active,,ZZ1 1AA,1 A Street,,96020 - y,", "5,Active,,bad,1 A Street,,96020,", "6,Active,,N1 1AA,,2 B Street,  96020x,"]
    (tmp_path / "b.csv").write_text(header + "\n".join(rows))
    slots = ["SICCode.SicText_1", "SICCode.SicText_2"]
    out = registers.sector_scan(files.bulk_csv(spark, str(tmp_path / "b.csv")), ["96020", "56302"], ["N", "E"], slots, "CompanyNumber", "CompanyStatus", "IncorporationDate", "RegAddress.PostCode", "RegAddress.AddressLine1", "RegAddress.AddressLine2")
    assert [(r.company_number, r.sector, r.incorporated, r.address_key) for r in out.orderBy("company_number").collect()] == [("1", "56302", "01/02/2020", "12 HIGH ROAD|N120NL"), ("2", "96020", "", "1 A STREET|N11AA"), ("6", "96020", "", "2 B STREET|N11AA")]


def test_authorities(spark):
    names = ["London Borough of Camden", "Kingston-upon-Thames", "City of London Corporation", "City of Westminster Council", "Royal Borough of Greenwich", "Leeds", None, "camden town"]
    wanted = ["camden", "kingston upon thames", "city of london", "westminster", "greenwich"]
    assert [r.name for r in registers.authorities(spark.createDataFrame([(n,) for n in names], "name string"), wanted).collect()] == names[:5]


def test_establishments(spark):
    rows = [
        {"FHRSID": 1, "BusinessName": " The Bakery ", "BusinessType": "Retailers - other", "AddressLine1": "The Bakery", "AddressLine2": "12 High Street", "AddressLine3": "London", "PostCode": "n1 1aa"},
        {"FHRSID": 2, "BusinessName": "X", "AddressLine1": "1 A Road", "PostCode": "N2 2BB"}, {"FHRSID": 3, "AddressLine1": "1 A Road", "PostCode": ""}, {"FHRSID": 4, "PostCode": "N2 2BB"},
    ]
    out = registers.establishments(spark.createDataFrame([("camden", json.dumps(r)) for r in rows] + [("camden", None)], "slice string, item string"))
    got = {}
    for r in out.collect():
        got.setdefault(r.fhrsid, set()).add(r.address_key)
        assert r.authority == "camden"
    assert set(got) == {1, 2} and "12 HIGH STREET|N11AA" in got[1] and got[2] == {"1 A ROAD|N22BB"} and all(k.endswith("|N11AA") for k in got[1])


def test_accounts_index(spark):
    item = "struct<category: string, type: string, date: string, action_date: string, description_values: struct<made_up_date: string>, links: struct<document_metadata: string>>"
    rows = [
        ("1", ("accounts", "AA", "2021-05-01", None, ("2020-12-31",), ("https://x/document/abc/",))), ("1", ("accounts", "AA", "2021-06-01", None, ("2020-12-31",), ("https://x/document/new",))),
        ("1", ("accounts", None, "2019-05-01", "2018-12-31", (None,), ("u/d",))), ("1", ("accounts", "AA", "2011-05-01", None, None, ("u/e",))), ("2", ("accounts", "AA", "2021-05-01", None, None, None)), ("2", ("officers", "AP01", "2021-05-01", None, None, ("u/f",))),
    ]
    out = registers.accounts_index(spark.createDataFrame(rows, f"entity string, item {item}"), "2012-01-01", "accounts")
    assert sorted((r.entity, r.made_up_to, r.document, r.place) for r in out.collect()) == [("1", "2018-12-31", "d", "accounts/1/2018-12-31_AA.pdf"), ("1", "2020-12-31", "new", "accounts/1/2020-12-31_AA.pdf")]


def test_lookups(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    with open("/tmp/quarrystone_lookup_stub", "w") as f:
        f.write(str(tmp_path / "calls"))
    try:
        asked = lambda: [open(tmp_path / "calls" / n).read().split() for n in os.listdir(tmp_path / "calls")]
        look = lambda names: {r.key: r.answer for r in registers.lookups(spark.createDataFrame([(n,) for n in names], "k string"), str(tmp_path / "t"), "tests.lookup_stub:bulk", "tests.lookup_stub:single", 25, 3).collect()}
        names = [f"k{i}" for i in range(100)] + ["o1", "gone", None, "", "k1"]
        got = look(names)
        assert len(got) == 102 and got["k7"] == '{"v": 7}' and got["o1"] == '{"old": "o1"}' and got["gone"] is None
        assert sum(map(len, asked())) == 102 and max(map(len, asked())) <= 25
        assert look([*names, "k100"]).keys() == {*got, "k100"} and sum(map(len, asked())) == 103  # what is known, unknown ones too, is not asked again
        assert look([]) == {}
    finally:
        os.remove("/tmp/quarrystone_lookup_stub")


def test_result_tables(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    os.makedirs(tmp_path / "few")
    for t in ("orders", "lineitem", "customer", "nation"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / "few" / f"{t}.parquet")
    assert len(exports.TABLES) == 19
    some = ("top_keys", "lifespan_summary", "succession_gaps")
    whole, exports.TABLES = exports.TABLES, {k: exports.TABLES[k] for k in some}
    try:
        assert exports.write_tables(spark, str(tmp_path / "few"), str(tmp_path / "out"), 4) == {"top_keys": 60, "lifespan_summary": 2, "succession_gaps": None}
    finally:
        exports.TABLES = whole
    assert len([f for f in os.listdir(tmp_path / "out/top_keys") if f.endswith(".csv")]) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out/lifespan_summary")).first()["mean"].split(".")[1].__len__() == 4


def test_renamed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).selectExpr("id as a", "id * 2 as b").write.parquet(path)
    schema = StructType().add("x", "long").add("b", "string")
    for _ in range(2):
        session.renamed(spark, path, {"a": "x"}, schema)
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(0, "0"), (1, "2"), (2, "4")] and os.listdir(tmp_path) == ["t"]
    with pytest.raises(ValueError, match="no such"):
        session.renamed(spark, path, {"q": "r"}, schema)


def test_medians_of_a_rank_test(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=31), rng.normal(size=40).round(1)
    df = spark.createDataFrame([(float(x), 1) for x in a] + [(float(x), 0) for x in b] + [(None, 1)], "v double, y int")
    r = stats.mann_whitney(df, "v", F.col("y") == 1).first()
    assert (r.n1, r.n2, r.median_1, r.median_2) == (31, 40, pytest.approx(np.median(a)), pytest.approx(np.median(b)))
    r = stats.mann_whitney(df.where("y = 0"), "v", F.col("y") == 1).first()
    assert r.u is None and r.median_1 is None and r.median_2 is None


def test_names_in_hot_blocks(spark):
    """A part that most names have is dealt to several tasks, and no match is lost."""
    rng = random.Random(3)
    names = sorted({f"GOLDEN DRAGON {''.join(rng.choice('ABCD') for _ in range(5))}" for _ in range(300)})
    asked = [n[:-1] + "X" for n in names[:40]] + ["GOLDEN DRAGN ABCDA", "DRAGON GOLDEN ABCD", "NOTHING"]
    q = spark.createDataFrame([(x,) for x in asked], "q string")
    r = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    found = [sorted(map(tuple, linkage.name_tiers(q, r, "q", "name", [F.col("id")], most).select("q", "tier", "candidates", "id").collect())) for most in (10**9, 20)]
    assert found[0] == found[1] and len(found[0]) >= 30
    one, two = linkage.dealt_blocks(q.select(F.lit("k").alias("key"), "q"), r.select(F.lit("k").alias("key"), "id"), "key", 20)
    assert one.join(two, ["key", "chunk"]).count() == len(asked) * len(names) and two.groupBy("chunk").count().agg(F.max("count")).first()[0] < 60
    assert company_name(F.lit("x")) is not None
