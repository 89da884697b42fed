"""Intervals, rank tests and ratings as column expressions and aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson limits within 0 and 1; null without trials."""
    n = F.when(n > 0, n.cast("double"))
    p, scale = k / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def two_proportions(k1: Column, n1: Column, k2: Column, n2: Column, z: float = Z95) -> dict[str, Column]:
    """Difference, its unpooled limits, the pooled z and its p; all null without trials, z and p also where all or none succeed."""
    n1, n2 = (F.when((n1 > 0) & (n2 > 0), n) for n in (n1, n2))
    p1, p2, pool = k1 / n1, k2 / n2, (k1 + k2) / (n1 + n2)
    se, pooled = F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2), F.sqrt(pool * (1 - pool) * (1 / n1.cast("double") + 1 / n2.cast("double")))
    score = (p1 - p2) / F.when(pooled > 0, pooled)
    return {"difference": p1 - p2, "low": p1 - p2 - z * se, "high": p1 - p2 + z * se, "z": score, "p": normal_p(score)}


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal z; null for null. For results: a row for each group that was tested."""

    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if pd.notna(x) else None).astype(float)

    return F.pandas_udf(run, "double")(z)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def clopper_pearson_of(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact limits of a proportion; (0, 1) without trials."""

    def root(a: float, b: float, level: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if incomplete_beta(a, b, mid) < level else (low, mid)
        return (low + high) / 2

    return (0.0 if k <= 0 else root(k, n - k + 1, alpha / 2), 1.0 if k >= n else root(k + 1, n - k, 1 - alpha / 2)) if n else (0.0, 1.0)


def clopper_pearson(df: DataFrame, k: str, n: str) -> DataFrame:
    """df with the exact limits low and high; df has a row for each group, so its rows are few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            limits = [clopper_pearson_of(int(a), int(b)) for a, b in zip(pdf[k], pdf[n])]
            yield pdf.assign(low=[x[0] for x in limits], high=[x[1] for x in limits])

    return df.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, low double, high double")


def sum_before(df: DataFrame, value: str, amount: str, name: str, buckets: int = 64) -> DataFrame:
    """df with the sum of ``amount`` over the rows of smaller ``value``, without a window over the whole table.

    Approximate quantiles, a few dozen numbers, deal the rows into value ranges; windows run within a range, and each range starts from
    the total of those below it.
    """
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    edges = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>")
    dealt = df.withColumn("__bucket", F.size(F.filter(edges, lambda cut: cut < F.col(value))))
    totals = dealt.groupBy("__bucket").agg(F.sum(amount).alias("__total"))
    below = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``buckets`` rows
    totals = totals.select("__bucket", F.coalesce(F.sum("__total").over(below), F.lit(0)).alias("__below"))
    own = Window.partitionBy("__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(totals), "__bucket").withColumn(name, F.col("__below") + F.coalesce(F.sum(amount).over(own), F.lit(0))).drop("__bucket", "__below")


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """n1, n2, U of the first group, rank-biserial effect, z with ties and continuity, p, and the medians of both; all but the sizes are null with a group under two rows."""
    cells = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"), F.sum(first.cast("int")).alias("ones"))
    ranked = sum_before(cells, value, "ties", "before").withColumn("midrank", F.col("before") + (F.col("ties") + 1) / 2)
    ties = F.col("ties").cast("double")
    s = ranked.agg(F.sum("ones").alias("n1"), (F.sum("ties") - F.sum("ones")).alias("n2"), F.sum(F.col("ones") * F.col("midrank")).alias("r1"), F.sum(ties * ties * ties - ties).alias("t"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u, n = F.col("r1") - n1 * (n1 + 1) / 2, n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    gap = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) * F.signum(u - n1 * n2 / 2)
    enough, score = (n1 >= 2) & (n2 >= 2), F.when((n1 >= 2) & (n2 >= 2) & (sigma > 0), gap / sigma)
    found = s.select("n1", "n2", F.when(enough, u).alias("u"), F.when(enough, 2 * u / (n1 * n2) - 1).alias("effect"), score.alias("z"))
    halves = quantiles(df.where(first.isNotNull()).withColumn("__arm", first), ["__arm"], value, {"m": 0.5})
    middles = halves.agg(F.max(F.when(F.col("__arm"), F.col("m"))).alias("median_1"), F.max(F.when(~F.col("__arm"), F.col("m"))).alias("median_2"))  # one row
    both = found.withColumn("p", normal_p(F.col("z"))).crossJoin(F.broadcast(middles))
    return both.withColumns({c: F.when(F.col("u").isNotNull(), F.col(c)) for c in ("median_1", "median_2")})


def inversions(x: np.ndarray) -> int:
    """Pairs out of order, equal ones apart: a larger value before a smaller one. Bit by bit from the top, all prefixes of a bit at once."""
    ranks = np.unique(x, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        prefix, one = ranks >> (bit + 1), (ranks >> bit) & 1
        order = np.argsort(prefix, kind="stable")
        prefix, one = prefix[order], one[order]
        before = np.cumsum(one) - one
        start = np.searchsorted(prefix, prefix)  # where the prefix begins
        total += int((before - before[start])[one == 0].sum())
    return total


def value_bucket(cuts: Column, value: Column) -> Column:
    """Two for each cut below the value, and one if it is a cut itself: a value that many rows share is a cut, and so has a bucket of its own, an odd one."""
    return F.size(F.filter(cuts, lambda c: c < value)) + F.size(F.filter(cuts, lambda c: c <= value))


def cuts_of(df: DataFrame, value: str, name: str, buckets: int) -> DataFrame:
    """One row with at most ``buckets`` - 1 values that part the column evenly, about.

    They depend on the order in which rows come, so they are found once, here: a plan that reads them twice must not find others the second time.
    """
    cuts = df.agg(F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(100 * buckets))).alias(name))
    return df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def discordant(df: DataFrame, a: str, b: str, buckets: int = 32) -> DataFrame:
    """One row, n: pairs of rows with a smaller a and a larger b, in n log n.

    The plane is cut into value ranges of a by value ranges of b. Pairs in different ranges of both are products of counts, a few thousand numbers; pairs in one range of a,
    and those in one range of b but not of a, are counted as inversions of a sorted run, a task for each range. A range of one value has no such pair,
    so what many rows share is never brought together.
    """
    both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where("a is not null and b is not null")
    cuts = cuts_of(both, "a", "ca", buckets).crossJoin(cuts_of(both, "b", "cb", buckets))
    dealt = both.crossJoin(F.broadcast(cuts)).select("a", "b", value_bucket(F.col("ca"), F.col("a")).alias("i"), value_bucket(F.col("cb"), F.col("b")).alias("j"))

    def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
        side = 2 * buckets + 1
        grid = np.zeros((side, side))
        grid[pdf["i"], pdf["j"]] = pdf["count"]
        larger = grid.astype(object)[:, ::-1].cumsum(axis=1)[:, ::-1]  # of larger or equal j, in whole numbers of any size
        above = np.zeros((side, side), object)
        above[:, :-1] = larger[:, 1:]
        before = np.zeros((side, side), object)
        before[1:] = above.cumsum(axis=0)[:-1]
        return pd.DataFrame({"n": [int((grid.astype(np.int64).astype(object) * before).sum())]})

    def within(keys: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(keys, kind="stable")
            return pd.DataFrame({"n": [inversions(pdf["b"].to_numpy())]})

        return run

    counted = dealt.groupBy("i", "j").count().withColumn("all", F.lit(0))
    parts = [counted.groupBy("all").applyInPandas(crossed, "n long")]
    parts += [dealt.where("i % 2 = 0").groupBy("i").applyInPandas(within(["a", "b"]), "n long"), dealt.where("j % 2 = 0").groupBy("j").applyInPandas(within(["i", "b"]), "n long")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def spearman_kendall(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """n, Spearman's rho of the ranks of a and b (ties take the last place) and Kendall's tau-a, in n log n. Rows without both are left out.

    The two columns are read a dozen times, so they are kept while the one row of the result is made.
    """
    rows = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").persist()
    place = lambda c: sum_before(rows.groupBy(c).agg(F.count("*").alias("ties")), c, "ties", "before").select(c, (F.col("before") + F.col("ties")).alias(f"r{c}"))
    ranked = rows.join(place("a"), "a").join(place("b"), "b")
    n = F.count("*").cast("double")
    rho = ranked.agg(F.count("*").alias("n"), (1 - F.try_divide(6 * F.sum(F.pow((F.col("ra") - F.col("rb")).cast("double"), 2)), n * (n * n - 1))).alias("spearman"))
    tied = lambda *c: rows.groupBy(*c).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("tied" + "".join(c)))
    counts = rho.crossJoin(tied("a")).crossJoin(tied("b")).crossJoin(tied("a", "b")).crossJoin(discordant(rows, "a", "b").withColumnRenamed("n", "against"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(pairs - F.col("tieda") - F.col("tiedb") + F.col("tiedab") - 2 * F.col("against"), pairs)
    found = counts.select("n", "spearman", tau.alias("kendall")).first()
    rows.unpersist()
    return df.sparkSession.createDataFrame([found], "n long, spearman double, kendall double")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by midranks."""
    cells = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("ties"), F.sum(label).alias("ones"))
    r = sum_before(cells, score, "ties", "before").withColumn("midrank", F.col("before") + (F.col("ties") + 1) / 2)
    s = r.agg(F.sum("ones").alias("n1"), (F.sum("ties") - F.sum("ones")).alias("n0"), F.sum(F.col("ones") * F.col("midrank")).alias("r"))
    return s.select("n1", "n0", ((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("auc"))


def quantiles(df: DataFrame, groups: list[str], value: str, wanted: dict[str, float], buckets: int = 32) -> DataFrame:
    """groups, n and the exact quantiles wanted, between values linearly: nulls are left out, and a group of nulls alone; without groups, one row.

    Equal values of a group count as one cell. Value ranges (cut about evenly over all cells, so that a group with many has many ranges) tell from their counts
    which of them hold the places that a quantile stands between; only those are sorted, a task for each range of a group.
    """
    rows = df.select(*groups, F.col(value).alias("__v")).where("__v is not null")
    cells = rows.groupBy(*groups, "__v").agg(F.count("*").alias("__ties"))
    cuts = cuts_of(cells, "__v", "__cuts", buckets)
    dealt = cells.crossJoin(F.broadcast(cuts)).withColumn("__bucket", value_bucket(F.col("__cuts"), F.col("__v"))).drop("__cuts")
    totals = dealt.groupBy(*groups, "__bucket").agg(F.sum("__ties").alias("__total"))
    of_group = Window.partitionBy(*(groups or [F.lit(0)]))  # at most 2 * buckets rows of a group
    below = F.coalesce(F.sum("__total").over(of_group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = totals.withColumns({"__below": below, "__n": F.sum("__total").over(of_group)})
    # places of a quantile: the rows, counted from 0, that it stands on or between
    at = {name: q * (F.col("__n") - 1).cast("double") for name, q in wanted.items()}
    places = F.array_distinct(F.array(*(f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil))))
    held = ranges.withColumn("__places", F.filter(places, lambda p: (p >= F.col("__below")) & (p < F.col("__below") + F.col("__total")))).where(F.size("__places") > 0).drop("__total")
    keys = [*groups, "__bucket"]
    held = held.withColumnsRenamed({c: f"__held_{c}" for c in keys})
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__held_{c}")) for c in keys))
    chosen = dealt.join(held, same).select(*keys, "__v", "__ties", "__below", "__n", "__places")
    run = Window.partitionBy(*groups, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("__below") + F.coalesce(F.sum("__ties").over(run), F.lit(0))
    hit = chosen.withColumn("__first", first).withColumn("__hit", F.explode(F.filter("__places", lambda p: (p >= F.col("__first")) & (p < F.col("__first") + F.col("__ties")))))
    found = hit.groupBy(*groups).agg(F.first("__n").alias("__n"), F.map_from_entries(F.collect_list(F.struct("__hit", F.col("__v").cast("double").alias("v")))).alias("__at"))  # two places a quantile

    def between(x: Column) -> Column:
        low, high, share = F.col("__at")[F.floor(x).cast("long")], F.col("__at")[F.ceil(x).cast("long")], x - F.floor(x)
        # weighted as DuckDB does it: 0.7 * 90 is a little below 63, and the value below ``high`` that this gives must be the same
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    return found.select(*groups, F.coalesce("__n", F.lit(0)).alias("n"), *(between(x).alias(name) for name, x in at.items()))


def winsorised(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df with the column clipped to its exact quantiles: one row of bounds, broadcast."""
    bounds = quantiles(df, [], value, {"__low": low, "__high": high}).drop("n")
    return df.crossJoin(F.broadcast(bounds)).withColumn(value, F.least(F.greatest(F.col(value), F.col("__low")), F.col("__high"))).drop("__low", "__high")
