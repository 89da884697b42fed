"""Operators that survive a hot key, against plain versions: the interval join, exact quantiles, Kendall's tau."""

import bisect
import itertools
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import linkage, prediction, stats

HOUR = 3_600_000_000
EVENT = "event_id long, user_id long, ts timestamp, kind string"


def first_within(spark, left, right, before=HOUR, after=24 * HOUR):
    """Rows are (id, user, microseconds, kind)."""
    made = lambda rows: spark.createDataFrame([(i, u, t, k) for i, u, t, k in rows], "event_id long, user_id long, us long, kind string").selectExpr("event_id", "user_id", "timestamp_micros(us) as ts", "kind")
    pool = made(right).selectExpr("user_id", "event_id as successor", "ts as successor_ts", "kind as successor_kind")
    out = linkage.first_within(made(left).drop("kind"), pool, "user_id", "ts", "successor_ts", before, after, "event_id", "successor")
    assert out.columns == ["event_id", "user_id", "ts", "successor", "successor_ts", "successor_kind"]
    return {r.event_id: (r.successor, r.successor_kind) for r in out.collect()}


def brute(left, right, before=HOUR, after=24 * HOUR):
    by = {}
    for i, u, t, k in right:
        if u is not None and t is not None:
            by.setdefault(u, []).append((t, i, k))
    for x in by.values():
        x.sort()
    out = {}
    for i, u, t, _ in left:
        found = None
        if t is not None:
            x = by.get(u, [])
            at = bisect.bisect_left(x, (t - before,))
            found = next((r for r in x[at : at + 2] if r[1] != i), None)
            found = found if found is not None and found[0] <= t + after else None
        out[i] = (found[1], found[2]) if found else (None, None)
    return out


def test_interval_join(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([None] + [rng.randrange(0, 400) * HOUR // 2 - 50 * HOUR for _ in range(20)]), rng.choice("abc")) for i in range(1500)]
    left, right = rows[:700], rows[300:]  # some are on both sides, many at one moment
    assert first_within(spark, left, right) == brute(left, right)
    assert first_within(spark, left, []) == {i: (None, None) for i, *_ in left} and first_within(spark, [], right) == {}
    assert first_within(spark, left, right, 0, 0) == brute(left, right, 0, 0)


def test_interval_join_of_a_hot_key(spark):
    """A key with a third of all rows, dense in time: its rows in an interval times its rows would be 10**9 pairs."""
    rng = random.Random(3)
    n = 120_000
    rows = [(i, 0 if i % 3 == 0 else i, rng.randrange(100 * HOUR), "x") for i in range(n)]
    began = time.time()
    assert first_within(spark, rows, rows) == brute(rows, rows)
    assert time.time() - began < 120


@pytest.mark.parametrize("buckets", [2, 32])
def test_quantiles(spark, buckets):
    rng = random.Random(buckets)
    rows = [("hot", rng.choice([7.0, 7.0, rng.gauss(0, 1), float(rng.randrange(5))])) for _ in range(3000)] + [(g, rng.choice([None, rng.random(), 1.0])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 40))] + [("none", None), ("one", -2.5), ("two", 1.0), ("two", 4.0)]
    wanted = {"low": 0.0, "q1": 0.25, "median": 0.5, "q99": 0.99, "high": 1.0}
    got = {r.g: r for r in stats.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], "x", wanted, buckets).collect()}
    by = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert set(got) == set(by)
    for g, x in by.items():
        assert got[g].n == len(x)
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-12)
    whole = stats.quantiles(spark.createDataFrame(rows, "g string, x double"), [], "x", wanted, buckets).collect()
    assert len(whole) == 1 and whole[0].median == pytest.approx(np.quantile([x for y in by.values() for x in y], 0.5))
    none = spark.createDataFrame([], "g string, x double")
    assert stats.quantiles(none, ["g"], "x", wanted, buckets).count() == 0 and stats.quantiles(none, [], "x", wanted, buckets).collect() == [(0, None, None, None, None, None)]


def test_quantiles_sort_few_rows(spark):
    """Only the ranges that hold a place are sorted."""
    df = spark.range(100_000).selectExpr("id * 1.0 as x")
    assert stats.quantiles(df, [], "x", {"median": 0.5}).first().median == 49_999.5
    plan = stats.quantiles(df, [], "x", {"median": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "CartesianProduct" not in plan


@pytest.fixture
def other_cuts_each_time(spark, monkeypatch):
    """Approximate quantiles that are others whenever a plan finds them, as they are on several executors, where rows come in any order."""

    def drawn(values):
        return sorted(random.SystemRandom().sample(values, min(len(values), 6)))

    monkeypatch.setattr(F, "percentile_approx", lambda value, *_: F.udf(drawn, "array<double>")(F.collect_list(F.col(value) if isinstance(value, str) else value.cast("double"))))


def test_cuts_are_found_once(spark, other_cuts_each_time):
    """Ranges are counted and sorted by the same cuts, also over kept rows."""
    rng = np.random.default_rng(6)
    a, b = np.round(rng.normal(size=600), 2), rng.normal(size=600)
    df = spark.createDataFrame([*zip(a.tolist(), b.tolist())], "a double, b double").persist()
    at = {f"d{i}": i / 10 for i in range(1, 10)}
    for c, x in (("a", a), ("b", b)):
        assert list(stats.quantiles(df, [], c, at).first())[1:] == pytest.approx(np.quantile(x, list(at.values())))
    assert stats.discordant(df, "a", "b").first().n == against(a, b)
    l = spark.createDataFrame([(i, 1, i * 7 % 300) for i in range(300)], "id int, k int, t int")  # noqa: E741
    r = spark.createDataFrame([(1, n) for n in range(0, 300, 3)], "k int, at int")
    met = prediction.as_of(l.persist(), r.persist(), "k", "t", "at", ["at"], most=10).collect()
    assert len(met) == 300 and all(x["at"] == x.t // 3 * 3 for x in met)
    for kept in (df, l, r):
        kept.unpersist()


def test_quantiles_on_a_place_that_doubles_miss(spark):
    """0.7 * 90 is a little below 63: the edge lies below the value there, or on it, as in DuckDB."""
    for low, high in ((0.651592973, 0.659480207), (0.835765104, 0.840092775), (0.23308445, 0.235393115), (0.5, 0.75)):
        x = [low - 1 + i / 100 for i in range(62)] + [low, high] + [high + 1 + i for i in range(27)]
        want = duckdb.sql(f"select quantile_cont(x, 0.7::double) from (select unnest({x}::double[]) as x)").fetchall()[0][0]
        got = stats.quantiles(spark.createDataFrame([(v,) for v in x], "x double"), [], "x", {"q": 0.7}).first().q
        assert got == pytest.approx(want, rel=1e-15) and (got < high) == (want < high)


def test_winsorised(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_cauchy(5000)
    got = sorted(r.x for r in stats.winsorised(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").collect())
    assert got == pytest.approx(sorted(np.clip(x, *np.quantile(x, [0.01, 0.99]))))
    assert stats.winsorised(spark.createDataFrame([(None,), (None,)], "x double"), "x").count() == 2


def against(a, b):
    return sum((x < y and u > v) or (x > y and u < v) for (x, u), (y, v) in itertools.combinations(zip(a, b), 2))


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        x = rng.integers(0, max(1, n // 2), n)
        assert stats.inversions(x) == sum(x[i] > x[j] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize(("kind", "buckets"), [("plain", 4), ("ties", 32), ("hot", 3)])
def test_kendall(spark, kind, buckets):
    rng = np.random.default_rng(4)
    n = {"few": 5}.get(kind, 400)
    a, b = rng.normal(size=n), rng.normal(size=n)
    b += a
    if kind == "ties":
        a, b = np.round(a), np.round(b, 1)
    if kind == "hot":
        a[rng.random(n) < 0.4] = 0.0
        b[rng.random(n) < 0.4] = 9.0
    df = spark.createDataFrame([*zip(range(n), a.tolist(), b.tolist()), (-1, None, 1.0), (-2, 1.0, None)], "i long, a double, b double").repartition(4)
    assert stats.discordant(df, "a", "b", buckets).first().n == against(a, b)
    r = stats.spearman_kendall(df, "i", "a", "b").first()
    sign = sum(np.sign(x - y) * np.sign(u - v) for (x, u), (y, v) in itertools.combinations(zip(a, b), 2))
    assert r.n == n and r.kendall == pytest.approx(sign / (n * (n - 1) / 2))
    last = lambda x: np.searchsorted(np.sort(x), x, side="right")
    assert r.spearman == pytest.approx(1 - 6 * ((last(a) - last(b)) ** 2).sum() / (n * (n * n - 1)))


def test_kendall_of_many_rows(spark):
    """Many rows with ties and a value that a third of them share; a brute force on a sample agrees."""
    df = spark.range(300_000).selectExpr("id", "if(id % 3 = 0, 0.5, round(rand(1), 4)) as a", "rand(2) as r").selectExpr("id", "a", "if(id % 5 = 0, 0.5, round((a + r) / 2, 4)) as b")
    began = time.time()
    got = stats.spearman_kendall(df, "id", "a", "b").first()
    assert got.n == 300_000 and time.time() - began < 120
    sample = df.where("id % 997 = 0").toPandas()
    a, b = sample["a"].to_numpy(), sample["b"].to_numpy()
    tau = (np.sign(a[:, None] - a) * np.sign(b[:, None] - b)).sum() / (len(a) * (len(a) - 1))
    assert got.kendall == pytest.approx(tau, abs=0.05)


def test_kendall_of_one_row(spark):
    r = stats.spearman_kendall(spark.createDataFrame([(1, 1.0, 2.0)], "i long, a double, b double"), "i", "a", "b").first()
    assert r.n == 1 and r.kendall is None
