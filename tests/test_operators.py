import json
import math
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.functions import classify, normalise
from quarrystone.operators import linkage, stats, survival
from quarrystone.session import append_flow, assert_unique
from quarrystone.sources import files, markup, paged
from quarrystone.streaming import ingest

LIVES = [("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("a", 3, 1), ("a", 5, 0), ("b", 2, 1), ("b", 2, 0), ("b", None, 1)]


def lives(spark, rows=LIVES):
    return spark.createDataFrame(rows, "g string, duration int, event int").withColumn("cause", F.col("event") * F.when(F.col("duration") == 3, 2).otherwise(1))


def test_kaplan_meier_by_hand(spark):
    got = {(r.g, r.time): (r.n, r.deaths, r.survival) for r in survival.kaplan_meier(lives(spark), ["g"]).collect()}
    assert got == {("a", 1): (5, 1, pytest.approx(0.8)), ("a", 3): (3, 2, pytest.approx(0.8 / 3)), ("b", 2): (2, 1, pytest.approx(0.5))}


def test_survival_before_the_first_event_is_one(spark):
    curve = survival.kaplan_meier(lives(spark), ["g"])
    got = {(r.g, r.horizon): r.survival for r in survival.survival_at(curve, ["g"], [0, 4]).collect()}
    assert got[("a", 0)] == 1 and got[("a", 4)] == pytest.approx(0.8 / 3)


def test_incidences_and_survival_add_to_one(spark):
    for r in survival.cumulative_incidence(lives(spark), ["g"]).collect():
        assert r.cif_1 + r.cif_2 + r.survival == pytest.approx(1)


def test_a_cause_beyond_those_counted_ends_no_life(spark):
    rows = spark.createDataFrame([(1, 9), (2, 1), (3, 2), (4, 0)], "duration int, cause int").withColumn("g", F.lit("a"))
    got = {r.time: (r.n, r.survival, r.cif_1, r.cif_2) for r in survival.cumulative_incidence(rows, ["g"]).collect()}
    assert got == {2: (3, pytest.approx(2 / 3), pytest.approx(1 / 3), 0), 3: (2, pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3))}


def test_logrank_of_equal_arms_expects_half(spark):
    rows = lives(spark, [(g, t, 1) for g in "ab" for t in (1, 2, 3)]).withColumn("s", F.lit(1))
    r = survival.logrank_sums(rows, ["s"], F.col("g") == "a").first()
    assert r.observed == 3 and r.expected == pytest.approx(3)


def test_logrank_has_a_p(spark):
    rows = lives(spark, [("a", t, 1) for t in (1, 2, 3)] + [("b", t, 1) for t in (4, 5, 6)]).withColumn("s", F.lit(1))
    r = survival.logrank(survival.logrank_sums(rows, ["s"], F.col("g") == "a")).first()
    assert r.ratio > 1 and r.chi2 == pytest.approx(r.z**2) and r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))
    none = survival.logrank(survival.logrank_sums(lives(spark, [("a", 1, 0)]).withColumn("s", F.lit(1)), ["s"], F.col("g") == "a"), "s")
    assert none.count() == 0


def test_bootstraps_bracket_the_estimate(spark):
    rows = lives(spark, [(g, t % 9 + 1, int(t % (3 if g == "a" else 2) == 0)) for g in "ab" for t in range(200)])
    r = survival.bootstrap_cif_difference(rows, "g", 5, replicates=60).first()
    assert r.low <= r.difference <= r.high
    c = survival.cluster_bootstrap(rows.withColumn("c", F.col("duration") % 4), "c", 5, replicates=40).first()
    assert 0 <= c.low <= c.mean <= c.high <= 1


def test_published_wilson_bounds(spark):
    low, high = stats.wilson(F.lit(2921), F.lit(7472))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(r.l, 5), round(r.h, 5)) == (0.37992, 0.40204)


@pytest.mark.parametrize(("k", "n", "low", "high"), [(0, 10, 0.0, 0.30850), (10, 10, 0.69150, 1.0), (5, 10, 0.18709, 0.81291)])
def test_clopper_pearson(k, n, low, high):
    assert stats.clopper_pearson_of(k, n) == (pytest.approx(low, abs=1e-5), pytest.approx(high, abs=1e-5))


def test_mann_whitney_and_auc_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0)], "v double, y int")
    assert stats.mann_whitney(df, "v", F.col("y") == 1).first().u == 0.5
    assert stats.auc(df, "v", "y").first().auc == pytest.approx(0.125)


def test_rank_test_of_too_few_is_null(spark):
    r = stats.mann_whitney(spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 0)], "v double, y int"), "v", F.col("y") == 1).first()
    assert (r.n1, r.n2, r.u, r.effect, r.z, r.p) == (1, 2, None, None, None, None)
    r = stats.mann_whitney(spark.createDataFrame([(float(x), x % 2) for x in range(20)], "v double, y int"), "v", F.col("y") == 1).first()
    assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)))


def test_two_proportions(spark):
    df = spark.createDataFrame([(30, 100, 20, 100), (0, 10, 0, 10), (1, 0, 1, 2)], "a int, b int, c int, d int")
    r, same, none = df.select(*(c.alias(k) for k, c in stats.two_proportions(F.col("a"), F.col("b"), F.col("c"), F.col("d")).items())).collect()
    assert r.difference == pytest.approx(0.1) and r.z == pytest.approx(1.63299, abs=1e-5) and r.p == pytest.approx(0.10247, abs=1e-5)
    assert same.difference == 0 and same.z is None and same.p is None
    assert set(none) == {None}


def test_csv_sinks_and_tolerant_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 'a "b", c'), (2, None, None)], "n int, x double, s string").coalesce(1)
    files.write_csv(df, f"{tmp_path}/fixed", decimals=4)
    files.write_csv(df, f"{tmp_path}/plain")
    back = files.bulk_csv(spark, f"{tmp_path}/fixed").orderBy("n").collect()
    assert [tuple(r) for r in back] == [("1", "0.5000", 'a "b", c'), ("2", None, None)]
    assert files.bulk_csv(spark, f"{tmp_path}/plain").orderBy("n").first().x == "0.5"
    texts = spark.createDataFrame([(" 12 ", "03-Feb-21"), ("", "3 Feb"), ("x1", "31-FEB-21"), (None, None)], "a string, b string")
    got = texts.select(files.whole_number(F.col("a")), files.day_of(F.col("b")).cast("string")).collect()
    assert [tuple(r) for r in got] == [(12, "2021-02-03"), (0, None), (0, None), (0, None)]


def test_sum_before_equals_a_whole_window(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("one"))
    got = [r.before for r in stats.sum_before(df, "v", "one", "before").orderBy("v").collect()]
    assert got == list(range(500))


def test_address_keys(spark):
    df = spark.createDataFrame([("Unit 4, 12 High Road London Greater London", "", "n12 0nl"), ("12 High Road", "", ""), ("", "3 Low Lane", "N1 1AA")], "a string, b string, p string")
    got = [r[0] for r in df.select(normalise.address_key(F.col("a"), F.col("b"), F.col("p"))).collect()]
    assert got == ["12 HIGH ROAD|N120NL", "", "3 LOW LANE|N11AA"]
    assert [r[0] for r in df.select(normalise.postcode(F.col("p"))).collect()] == ["N12 0NL", "", "N1 1AA"]


@pytest.mark.parametrize(
    ("one", "two", "address", "agent"),
    [
        ("C/O SMITH LTD, 12 HIGH STREET", "", "12 HIGH STREET", "SMITH LTD,"),
        ("c/o Smith and Co", "9 Low Road", "9 Low Road", "Smith and Co"),
        ("Care of Smith", None, "", "Smith"),
        ("12 C/O SMITH AND CO HIGH STREET", "", "12 HIGH STREET", "SMITH AND CO"),
        ("12 C.O PARK AND CO HIGH ROAD LONDON", "", "12 HIGH ROAD", "PARK AND CO"),
        ("12 c/o Parade Ltd", "", "12 Parade", None),
        ("12 C/O Smith Ltd", "", "12 Smith Ltd", None),
        ("12 High Street C/O Smith", "", "12 High Street C/O Smith", None),
        (None, " 3 Low Lane ", "3 Low Lane", None),
        (None, None, "", None),
    ],
)
def test_care_of(spark, one, two, address, agent):
    r = spark.createDataFrame([(one, two)], "a string, b string").select(normalise.care_of(F.col("a"), F.col("b")).alias("r")).first().r
    assert (r.address, r.agent) == (address, agent)


@pytest.mark.parametrize(
    ("line", "street"),
    [("C/O SMITH LTD, Flat 2, 12 High Street", "12 HIGH STREET"), ("Apt 3b: 12 High Road", "12 HIGH ROAD"), ("Rear of 12 High Road", "HIGH ROAD"), ("Part First Floor, 12 High Road", "HIGH ROAD"), ("Basement - 12 High Road UK", "HIGH ROAD")],
)
def test_address_key_drops_agents_and_units(spark, line, street):
    r = spark.range(1).select(normalise.address_key(F.lit(line), F.lit(None).cast("string"), F.lit("n1 1aa")).alias("k")).first()
    assert r.k == f"{street}|N11AA"


def test_first_within_takes_the_earliest_and_keeps_the_dark(spark):
    left = spark.createDataFrame([(1, "x", 10), (2, "y", 10)], "id int, k string, died int")
    right = spark.createDataFrame([("x", 12, "late"), ("x", 11, "early"), ("x", 99, "never")], "k string, born int, name string")
    got = {r.id: r.name for r in linkage.first_within(left, right, "k", "died", "born", 0, 5, "id", "name").collect()}
    assert got == {1: "early", 2: None}


def test_any_key_join_is_distinct(spark):
    left = spark.createDataFrame([(1, "p", "p", None), (2, "", "q", None)], "id int, a string, b string, c string")
    right = spark.createDataFrame([("p", 7), ("q", 8), ("", 9)], "k string, f int")
    assert sorted((r.id, r.f) for r in linkage.any_key_join(left, right, ["a", "b", "c"], "k").collect()) == [(1, 7), (2, 8)]


def test_classifiers(spark):
    e = spark.createDataFrame([(1, "court", 1), (1, "vol", 2), (2, "vol", 1), (2, "back", 2), (3, "other", 1)], "id int, kind string, at int")
    assert {r.id: r.route for r in classify.priority_route(e, "id", "kind", [("court", ["court"]), ("voluntary", ["vol"])]).collect()} == {1: "court", 2: "voluntary", 3: "unknown"}
    got = {r.id: r.route for r in classify.last_event_route(e, "id", "kind", "at", {"court": "court", "vol": "voluntary"}, {"vol": "back"}).collect()}
    assert got == {1: "voluntary", 2: "unknown", 3: "unknown"}


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=12))
def test_numbers_never_raise(text):
    x = markup.number(text, "0", None)
    assert x is None or math.isfinite(x)


def test_files(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/01.json").write_text(json.dumps([{"category": "accounts", "date": "2020-01-01", "description": "dormant"}, {"category": "insolvency", "date": "2021-01-01"}]))
    r = files.filing_footprint(files.histories(spark, str(tmp_path / "h"))).first()
    assert (r.entity, r.n_filings, r.ever_dormant, r.first_insolvency) == ("01", 2, True, "2021-01-01")
    (tmp_path / "b.csv").write_text(" CompanyNumber, Name\n1,x\n")
    assert files.bulk_csv(spark, str(tmp_path / "b.csv")).columns == ["CompanyNumber", "Name"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.html", "hi")
        z.writestr("y.txt", "no")
    assert [bytes(r.content) for r in files.archive_members(spark, str(tmp_path / "a.zip"), r".*\.html").collect()] == [b"hi"]
    for part in ([(1, "m1")], [(2, "m1"), (3, "m2")]):
        files.write_partition(spark.createDataFrame(part, "x int, m string"), str(tmp_path / "p"), "m")
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [1, 3]


def test_flow_is_idempotent(spark, tmp_path):
    flow = spark.createDataFrame([("s1", "a", 1, ""), ("s2", "b", 2, "")], "step string, stage string, n long, note string")
    append_flow(flow, str(tmp_path / "f"))
    append_flow(flow.where("step = 's1'"), str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    with pytest.raises(ValueError):
        assert_unique(flow.union(flow), "step")


def fake_fetch(query, start, size):
    return {"hits": 250, "items": [{"n": i, "q": query} for i in range(start, min(start + size, 250))]}


def test_paged_items():
    assert len(list(paged.all_items(fake_fetch, "q"))) == 250


def test_ingest_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text('{"k": %d}\n{"k": 7}\n' % i)
        ingest.new_files(spark, str(tmp_path / "in"), "k int", str(tmp_path / "out"), str(tmp_path / "cp"), ["k"])
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 7]


def brute_tiers(names, register, bare=lambda n: n):
    """The first tier with hits of each name by comparing it with every row; smallest id, and number of hits."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    out = {}
    for n in names:
        b, tokens = bare(n), sorted(n.split(" "))
        tests = [lambda r: r == n, lambda r: r == b, lambda r: edits(n, r) <= (2 if len(n) > 12 else 1), lambda r: sorted(r.split(" ")) == tokens]
        hits = next(((t, h) for t, f in enumerate(tests, 1) if (h := [i for i, r in register if f(r)])), None)
        if hits:
            out[n] = (min(hits[1]), hits[0], len(hits[1]))
    return out


def test_name_tiers_query_takes_whole_tables(spark, tmp_path):
    from quarrystone.plans.registry import QUERIES

    ids = [0, 199, 200, 201, 202, 203, 1999, 2000, 2400, 5001, 5002]
    names = [f"{chr(97 + i) * 6} {chr(122 - i) * 6}" for i in range(len(ids))]
    spark.createDataFrame(list(zip(ids, names)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.query: (r.p_partkey, r.tier, r.candidates) for r in QUERIES["Q52_name_tiers"](spark, str(tmp_path)).collect()}
    made = lambda i, n: (n.upper(), f"{n} (UK) Ltd", n + "s", " ".join(n.split()[::-1]))[i % 4]
    plain = {made(i, n): made(i, n).upper().removesuffix(" (UK) LTD") for i, n in zip(ids, names)}
    want = brute_tiers(plain.values(), list(zip(ids, map(str.upper, names))))
    assert {q: (i, 1 if t == 2 else t, n) for q, (i, t, n) in got.items()} == {q: want[n] for q, n in plain.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_name_tiers_finds_typos_anywhere(spark, seed):
    from random import Random

    rng = Random(seed)
    names = ["ACME", "ZENITH HOLDINGS", "NORTHWIND TRADERS", "A", "AB", "", "OLD ROD", "COLD ROD", "TWELVE CHARS", "THIRTEEN CHAR"]
    names += [" ".join("".join(rng.choices("ABC", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 3))) for _ in range(60)]

    def typo(n):
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randint(0, len(n)), rng.randint(0, 2)
            n = n[:at] + ("" if kind == 0 else rng.choice("ABCX")) + n[at + (kind < 2) :]
        return " ".join(n.split())

    asked = {"BCME", "XENITH HOLDINGS", "NORHTWIND TRADERS", "ORTHWIND TRADERS", "TRADERS NORTHWIND", *(typo(n) for n in names for _ in range(3))}
    register = list(enumerate(names)) + [(100, "ACME"), (101, "ACME")]
    q = spark.createDataFrame([(n,) for n in sorted(asked)], "query string")
    r = spark.createDataFrame(register, "id long, name string")
    got = {x.query: (x.id, x.tier, x.candidates) for x in linkage.name_tiers(q, r, "query", "name", [F.col("id")]).collect()}
    assert got == brute_tiers(asked, register)
    assert got["BCME"] == (0, 3, 3) and got["XENITH HOLDINGS"][:2] == (1, 3) and got["NORHTWIND TRADERS"][:2] == (2, 3)


def test_cluster_bootstrap_query_draws_as_often_as_the_reference(spark):
    from quarrystone.plans.registry import QUERIES

    got = {r.method: r.replicates for r in QUERIES["Q47r_bootstrap_cif"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"rows": 400, "clusters": 300}
