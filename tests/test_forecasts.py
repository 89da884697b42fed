"""Point-in-time frames, logistic fits and bootstraps against plain numpy."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import logit, prediction, survival


def as_of(spark, left, right, buckets=32):
    l = spark.createDataFrame(left, "id int, k int, t int").repartition(3)  # noqa: E741
    r = spark.createDataFrame(right, "k int, at int, n int, what string").repartition(2)
    out = prediction.as_of(l, r, "k", "t", "at", ["n"], buckets)
    assert out.columns == ["id", "k", "t", "at", "n", "what"]
    return sorted(map(tuple, out.collect()), key=repr)


def brute(left, right):
    by = {}
    for k, at, n, what in right:
        if k is not None and at is not None:
            by.setdefault(k, []).append((at, n, what))
    for x in by.values():
        x.sort()
    out = []
    for i, k, t in left:
        x = by.get(k, [])
        j = bisect.bisect_right(x, (t, 10**9, "")) if t is not None else 0
        out.append((i, k, t, *(x[j - 1] if j else (None, None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("buckets", [1, 7])
def test_as_of(spark, buckets):
    rng = random.Random(buckets)
    left = [(i, rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice([None, *range(60)])) for i in range(500)]
    left += [left[3], left[3]]  # repeated questions
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(0, 60, 4), -50, 90]), n, f"r{n}") for n in range(150)]
    assert as_of(spark, left, right, buckets) == brute(left, right)
    assert as_of(spark, left, [], buckets) == brute(left, []) and as_of(spark, [], right, buckets) == []


def test_as_of_of_a_hot_key(spark):
    """A third of all rows under one key, without a pair of rows."""
    rng = random.Random(8)
    left = [(i, 0 if i % 3 == 0 else i, rng.randrange(10**6)) for i in range(60_000)]
    right = [(0 if n % 3 == 0 else n, rng.randrange(10**6), n, "x") for n in range(60_000)]
    assert as_of(spark, left, right) == brute(left, right)


@pytest.mark.parametrize("most", [0, 20, 100])
def test_as_of_cuts_crowded_keys_alone(spark, most):
    """Some keys cut and others not; the same rows, whichever are named."""
    rng = random.Random(most)
    left = [(i, rng.choice([1, 1, 1, 2, 3, 9, None]), rng.choice([None, *range(60)])) for i in range(300)]
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice([None, *range(0, 60, 4), -50, 90]), n, f"r{n}") for n in range(100)]
    l, r = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, at int, n int, what string")
    named = spark.createDataFrame([(k,) for k in (2, 2, 77, None)], "k int")
    for crowded in (None, named):
        got = prediction.as_of(l, r, "k", "t", "at", ["n"], 7, most, crowded).collect()
        assert sorted(map(tuple, got), key=repr) == brute(left, right)


def test_as_of_is_one_shuffle_without_crowded_keys(spark):
    l, r = spark.createDataFrame([(1, 1, 5)], "id int, k int, t int"), spark.createDataFrame([(1, 4, 0, "x")], "k int, at int, n int, what string")
    assert prediction.as_of(l, r, "k", "t", "at", ["n"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_exit_frame_knows_nothing_later(spark):
    day = dt.date
    lives = spark.createDataFrame([(1, day(2019, 6, 1), 100, True), (2, day(2019, 6, 1), 2000, False), (3, day(2019, 6, 1), 50, False), (4, day(2019, 6, 1), 10, True), (5, day(2022, 2, 2), 2000, True)], "e int, born date, days int, event boolean")
    accounts = spark.createDataFrame([
        (1, day(2018, 1, 1), -5.0, 1.0, 2.0, 3.0, 4), (1, day(2019, 6, 1), 5.0, 1.0, 4.0, 3.0, 4), (1, day(2019, 6, 2), -9.0, 9.0, 9.0, 9.0, 9), (2, day(2018, 5, 5), 1.0, 0.0, 1.0, 2.0, 500),
        (3, day(2018, 5, 5), 1.0, 0.0, 1.0, 2.0, 5), (4, day(2020, 5, 5), 1.0, 0.0, 1.0, 2.0, 5), (5, day(2022, 1, 1), 1.0, 0.5, 1.0, 2.0, 0),
    ], "e int, made_up date, equity double, cash double, current double, creditors double, staff int")
    columns = {c: c for c in ("equity", "cash", "current", "creditors", "staff")}
    got = prediction.exit_frame(lives, accounts, "e", "born", "days", "event", "made_up", ["made_up"], columns, (2018, 2021), 2022)
    rows = {r.e: (r.acc_year, r.label, r.negative_equity, r.cash_share, r.negative_capital, round(r.log_staff, 4), r.part) for r in got.collect()}
    assert rows == {1: (2019, 1, 0.0, 0.25, 0.0, 1.6094, "train"), 2: (2018, 0, 0.0, 0.0, 1.0, 4.6151, "train"), 5: (2022, 0, 0.0, 0.5, 1.0, 0.0, "test")}


def plain_irls(x, y, w, ridge, steps=30):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-x @ beta))
        v = np.maximum(mu * (1 - mu), 1e-9)
        a = (x * (w * v)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        new = np.linalg.solve(a, x.T @ (w * v * (x @ beta + (y - mu) / v)))
        if np.abs(new - beta).max() < 1e-10:
            return new, a
        beta = new
    return beta, a


@pytest.mark.parametrize(("ridge", "weighted"), [(1e-8, False), (2.0, True)])
def test_irls(spark, ridge, weighted):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=800), rng.integers(0, 2, 800), rng.normal(size=800) ** 2, np.ones(800)])
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ [0.7, -1.2, 0.3, -0.4])))).astype(float)
    w = rng.integers(0, 4, 800).astype(float) if weighted else np.ones(800)
    df = spark.createDataFrame([(*map(float, r[:3]), float(t), float(v)) for r, t, v in zip(x, y, w)] + [(None, 1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, y double, w double").repartition(5)
    fit = logit.irls(df, ["a", "b", "c"], "y", "w" if weighted else None, ridge)
    beta, matrix = plain_irls(x, y, w, ridge)
    got = {r.term: r for r in fit.collect()}
    assert list(got) == ["a", "b", "c", "intercept"]
    assert [r.coefficient for r in got.values()] == pytest.approx(beta, abs=1e-8)
    assert [r.error for r in got.values()] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(matrix))), rel=1e-6)
    scores = logit.predicted(df.where("a is not null"), fit).select("score", "y").collect()
    assert sorted(r.score for r in scores) == pytest.approx(sorted(1 / (1 + np.exp(-x @ beta))), abs=1e-8)


def test_irls_of_odd_tables(spark):
    """A term that never varies is held by the ridge; without rows all is nought."""
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (0.0, 1.0)], "a double, y double")
    got = {r.term: r.coefficient for r in logit.irls(df, ["a"], "y").collect()}
    assert got["a"] == 0 and got["intercept"] == pytest.approx(np.log(2), abs=1e-6)
    assert [r.coefficient for r in logit.irls(df.where("false"), ["a"], "y").collect()] == [0.0, 0.0]


def test_deciles(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.5, 0.5, rng.random()]), int(rng.random() < 0.3)) for _ in range(400)]
    got = prediction.deciles(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()
    edges = sorted(set(np.quantile([s for s, _ in rows], [i / 10 for i in range(1, 10)])))
    want = {}
    for s, y in rows:
        want.setdefault(1 + sum(e < s for e in edges), []).append(y)
    assert {r.decile: (r.n, round(r.value, 9)) for r in got if r.part == "decile"} == {d: (len(y), round(sum(y) / len(y), 9)) for d, y in want.items()}
    ones, rest = ([s for s, y in rows if y == k] for k in (1, 0))
    assert [r.value for r in got if r.part == "auc"] == pytest.approx([np.mean([(a > b) + (a == b) / 2 for a in ones for b in rest])])


def incidence(time, cause, horizon):
    s, total = 1.0, 0.0
    for t in np.unique(time[time <= horizon]):
        n = (time >= t).sum()
        total += s * ((time == t) & (cause == 1)).sum() / n
        s *= 1 - ((time == t) & (cause > 0) & (cause < 3)).sum() / n
    return total


@pytest.fixture(scope="module")
def lives():
    rng = np.random.default_rng(12)
    n = 900
    arm, cluster = rng.integers(0, 3, n), rng.integers(0, 150, n)
    time = np.ceil(rng.exponential(400 + 200 * arm) + 60 * (cluster % 5)).astype(int)
    cause = rng.choice([0, 1, 2, 9], n, p=[0.3, 0.4, 0.25, 0.05])
    return arm, cluster, time, cause


def frame(spark, lives):
    return spark.createDataFrame([(f"a{a}", f"c{c}", int(t), int(x)) for a, c, t, x in zip(*lives)] + [("a0", "c1", None, 1)], "arm string, cluster string, duration int, cause int").repartition(3)


def test_bootstrap_of_arms(spark, lives):
    arm, _, time, cause = lives
    got = survival.bootstrap_cif_difference(frame(spark, lives), "arm", 500, replicates=400, together=64).collect()
    assert {(r.first, r.second) for r in got} == {("a0", "a1"), ("a0", "a2"), ("a1", "a2")}
    rng = np.random.default_rng(0)
    for r in got:
        a, b = int(r.first[1]), int(r.second[1])
        assert r.replicates == 400 and r.difference == pytest.approx(incidence(time[arm == a], cause[arm == a], 500) - incidence(time[arm == b], cause[arm == b], 500), abs=1e-9)
        drawn = []
        for _ in range(300):
            i, j = (rng.choice(np.flatnonzero(arm == x), (arm == x).sum()) for x in (a, b))
            drawn.append(incidence(time[i], cause[i], 500) - incidence(time[j], cause[j], 500))
        low, high = np.percentile(drawn, [2.5, 97.5])
        assert abs(r.low - low) < 0.25 * (high - low) and abs(r.high - high) < 0.25 * (high - low)
    again = survival.bootstrap_cif_difference(frame(spark, lives).repartition(7), "arm", 500, replicates=400, together=64).collect()
    assert sorted(got) == sorted(again)


def test_bootstrap_of_clusters(spark, lives):
    _, cluster, time, cause = lives
    r = survival.cluster_bootstrap(frame(spark, lives), "cluster", 500, replicates=400, together=16).first()
    rng = np.random.default_rng(0)
    names, drawn = np.unique(cluster), []
    rows = {c: np.flatnonzero(cluster == c) for c in names}
    for _ in range(400):
        i = np.concatenate([rows[c] for c in rng.choice(names, len(names))])
        drawn.append(incidence(time[i], cause[i], 500))
    low, high = np.percentile(drawn, [2.5, 97.5])
    assert r.replicates == 400 and r["mean"] == pytest.approx(np.mean(drawn), abs=0.15 * (high - low))
    assert abs(r.low - low) < 0.2 * (high - low) and abs(r.high - high) < 0.2 * (high - low)
    assert survival.cluster_bootstrap(frame(spark, lives).repartition(9), "cluster", 500, replicates=400, together=16).first() == r
    assert survival.cluster_bootstrap(frame(spark, lives).where("false"), "cluster", 500).first().replicates == 0


def test_draws_add_up():
    ends = np.cumsum([5, 1, 0, 30, 4, 60])
    drawn = np.stack([survival.draws_of(b, ends, 2000, 1) for b in range(6)])
    assert (drawn.sum(0) == 100).all() and (drawn[2] == 0).all()
    assert drawn.mean(1) == pytest.approx([5, 1, 0, 30, 4, 60], rel=0.1)
    assert np.corrcoef(drawn[3], drawn[5])[0, 1] < -0.5  # what one bucket gets another lacks


def test_hot_cluster_is_counted_first(spark):
    """Half of all rows in one cluster are as many cells as there are days."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("cluster"), (F.col("id") % 700).cast("int").alias("duration"), (F.col("id") % 3).cast("int").alias("cause"))
    assert survival.cells_of(df.where("cluster = -1"), ["cluster"], 500, 2).count() <= 3 * 502
    r = survival.cluster_bootstrap(df, "cluster", 500, replicates=50).first()
    assert r.low <= r["mean"] <= r.high and r.replicates == 50


def test_cluster_bootstrap_reads_its_rows_twice(spark):
    """For the clusters' names and for their counts, and the sizes of the buckets come from the names."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    rows = spark.createDataFrame([(i % 7, i % 40, i % 3) for i in range(300)], "k int, duration int, cause int").mapInPandas(counted, "k int, duration int, cause int")
    assert survival.cluster_bootstrap(rows, "k", 30, 20, together=3).first().replicates == 20
    assert seen.value <= 600
