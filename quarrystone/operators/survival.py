"""Survival estimators as windows over counts by group and time.

Rows are first counted by (group, time), so a window sees each distinct time once: its size is bounded by the number
of distinct durations, not by the number of rows, and a group with a third of all rows costs no more than the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.stats import normal_p

Z95 = 1.96


def at_risk_counts(df: DataFrame, groups: list[str], time: str, **sums: Column) -> DataFrame:
    """Of each group and distinct time: the given sums, and n, how many rows have that time or a later one."""
    counts = df.where(F.col(time).isNotNull()).groupBy(*groups, F.col(time).alias("time")).agg(F.count("*").alias("leaving"), *(F.sum(c).alias(k) for k, c in sums.items()))
    back = Window.partitionBy(*groups).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("n", F.sum("leaving").over(back))


def kaplan_meier(df: DataFrame, groups: list[str], time: str = "duration", event: str = "event") -> DataFrame:
    """groups, time (event times only), n, deaths, survival, variance (Greenwood). Null durations take no part."""
    steps = at_risk_counts(df, groups, time, deaths=F.col(event)).where("deaths > 0")
    upto = Window.partitionBy(*groups).orderBy("time").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    greenwood = F.when(F.col("n") > F.col("deaths"), F.col("deaths") / (F.col("n") * (F.col("n") - F.col("deaths"))))
    survival = F.product(1 - F.col("deaths") / F.col("n")).over(upto)
    return steps.withColumn("survival", survival).withColumn("variance", F.col("survival") * F.col("survival") * F.coalesce(F.sum(greenwood).over(upto), F.lit(0.0))).drop("leaving")


def survival_at(curve: DataFrame, groups: list[str], horizons: list[int]) -> DataFrame:
    """S and its variance at each horizon: of the last event time up to it, else 1 and 0."""
    wide = curve.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    reached = F.col("time") <= F.col("horizon")
    return wide.groupBy(*groups, "horizon").agg(
        F.coalesce(F.max_by("survival", F.when(reached, F.col("time"))), F.lit(1.0)).alias("survival"),
        F.coalesce(F.max_by("variance", F.when(reached, F.col("time"))), F.lit(0.0)).alias("variance"),
    )


def sampled_curve(curve: DataFrame, groups: list[str], end: int = 1120, step: int = 10) -> DataFrame:
    """S at every ``step`` days up to ``end``, for charts."""
    return survival_at(curve, groups, list(range(0, end + 1, step))).drop("variance")


def loglog_interval(s: Column, variance: Column, z: float = Z95) -> tuple[Column, Column]:
    """Confidence limits of S on the log-log scale; S itself where that scale has no value."""
    plain = (s <= 0) | (s >= 1) | (variance <= 0)
    safe = F.when(plain, F.lit(0.5)).otherwise(s)
    half = z * F.sqrt(variance) / F.abs(safe * F.ln(safe))
    return F.when(plain, s).otherwise(F.pow(safe, F.exp(half))), F.when(plain, s).otherwise(F.pow(safe, F.exp(-half)))


def median_survival(curve: DataFrame, groups: list[str]) -> DataFrame:
    return curve.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def logrank_sums(df: DataFrame, strata: list[str], first_arm: Column, time: str = "duration", event: str = "event") -> DataFrame:
    """Of each stratum: observed and expected deaths of the first arm, and the hypergeometric variance with ties."""
    arm = first_arm.cast("int")
    steps = at_risk_counts(df, strata, time, deaths=F.col(event), deaths1=F.col(event) * arm, leaving1=arm)
    back = Window.partitionBy(*strata).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("n1", F.sum("leaving1").over(back)).where("deaths > 0 and n > 1")
    n, n1, d = (F.col(c).cast("double") for c in ("n", "n1", "deaths"))
    return steps.groupBy(*strata).agg(F.sum("deaths1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).alias("variance"))


def logrank(sums: DataFrame, *by: str) -> DataFrame:
    """Of each ``by`` (none: over all strata): observed, expected, variance, their ratio, z, chi2 and p from logrank_sums; null without variance."""
    total = sums.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("observed", "expected", "variance")))
    z = F.when(F.col("variance") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("variance"))
    total = total.withColumn("ratio", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected"))).withColumn("z", z).withColumn("chi2", F.col("z") * F.col("z"))
    return total.withColumn("p", normal_p(F.col("z")))


def cumulative_incidence(df: DataFrame, groups: list[str], time: str = "duration", cause: str = "cause", causes: int = 2) -> DataFrame:
    """groups, time, n, survival, cif_1.. (Aalen-Johansen). Cause 0 is censored; at a cause beyond ``causes`` a life leaves
    those at risk and survival does not fall."""
    sums = {f"d{k}": (F.col(cause) == k).cast("int") for k in range(1, causes + 1)}
    steps = at_risk_counts(df, groups, time, ended=F.col(cause).between(1, causes).cast("int"), **sums).where("ended > 0")
    order = Window.partitionBy(*groups).orderBy("time")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("survival", F.product(1 - F.col("ended") / F.col("n")).over(upto))
    steps = steps.withColumn("before", F.lag("survival", 1, 1.0).over(order))
    return steps.select(*groups, "time", "n", "survival", *(F.sum(F.col("before") * F.col(f"d{k}") / F.col("n")).over(upto).alias(f"cif_{k}") for k in range(1, causes + 1)))


def cif_at(curve: DataFrame, groups: list[str], horizon: int, causes: int = 2) -> DataFrame:
    reached = F.when(F.col("time") <= horizon, F.col("time"))
    return curve.groupBy(*groups).agg(*(F.coalesce(F.max_by(f"cif_{k}", reached), F.lit(0.0)).alias(f"cif_{k}") for k in range(1, causes + 1)))


def cells_of(df: DataFrame, keys: list[str], horizon: int, causes: int) -> DataFrame:
    """keys, time, kind (1: the first cause, 2: another one, 0: neither) and count; times beyond the horizon are one, as nothing later matters up to it."""
    kind = F.when(F.col("cause") == 1, 1).when(F.col("cause").between(2, causes), 2).otherwise(0)
    rows = df.where(F.col("duration").isNotNull()).select(*keys, F.least(F.col("duration").cast("double"), F.lit(horizon + 1.0)).alias("time"), kind.alias("kind"))
    return rows.groupBy(*keys, "time", F.when(F.col("time") <= horizon, F.col("kind")).otherwise(0).alias("kind")).count()


def incidences(leaving: np.ndarray, ended: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Incidence of the first cause at the end of the times, for each row of counts by rising time."""
    risk = np.maximum(leaving[:, ::-1].cumsum(1)[:, ::-1], 1)
    survived = np.cumprod(1 - ended / risk, 1)
    before = np.concatenate([np.ones((len(leaving), 1)), survived[:, :-1]], 1)
    return (before * first / risk).sum(1)


def bootstrap_cif_difference(df: DataFrame, arm: str, horizon: int, replicates: int = 400, seed: int = 12345, causes: int = 2, together: int = 50) -> DataFrame:
    """first, second, difference, low, high, replicates of every pair of arms: percentile interval of the difference of cause-1 incidence at a horizon.

    Rows of one (arm, time, kind) are alike, so a replicate draws the counts of an arm's cells at once, by conditional binomials; cells are as many as the days up to the horizon,
    whatever the number of rows. Arms and blocks of replicates are tasks, and a block's numbers come from (seed, arm, block) alone.
    """
    blocks = -(-replicates // together)
    cells = cells_of(df.where(F.col(arm).isNotNull()), [arm], horizon, causes).withColumnRenamed(arm, "arm").withColumn("arm", F.col("arm").cast("string"))
    spread = cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks))))  # block 0 is the rows as they are

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, block = pdf["arm"].iloc[0], int(pdf["block"].iloc[0])
        pdf = pdf.sort_values(["time", "kind"])
        times, at = np.unique(pdf["time"], return_inverse=True)
        count, kind = pdf["count"].to_numpy(np.int64), pdf["kind"].to_numpy()
        if block:
            rng = np.random.default_rng([seed, block, *name.encode()])
            drawn = rng.multinomial(count.sum(), count / count.sum(), min(together, replicates - (block - 1) * together))
        else:
            drawn = count[None]
        by_time = np.zeros((3, len(drawn), len(times)))
        for row, cells in zip(by_time, (kind >= 0, kind > 0, kind == 1)):
            for c in np.flatnonzero(cells):
                row[:, at[c]] += drawn[:, c]
        return pd.DataFrame({"arm": name, "replicate": (block - 1) * together + np.arange(1, len(drawn) + 1) if block else 0, "cif": incidences(*by_time)})

    each = spread.groupBy("arm", "block").applyInPandas(run, "arm string, replicate long, cif double")  # a row for each arm and replicate
    a, b = (each.select(F.col("arm").alias(name), "replicate", F.col("cif").alias(f"cif_{name}")) for name in ("first", "second"))
    pairs = a.join(b, "replicate").where("first < second").withColumn("difference", F.col("cif_first") - F.col("cif_second"))
    drawn = F.when(F.col("replicate") > 0, F.col("difference"))
    return pairs.groupBy("first", "second").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("difference"))).alias("difference"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"), F.count(drawn).alias("replicates")
    )


def draws_of(bucket: int, ends: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall to a bucket, ends being the clusters up to the end of each bucket, all clusters drawn as often as there are.

    The buckets are halved again and again; a half's share of its whole is binomial, and its numbers come from (seed, half) alone, so every task finds the same.
    """
    low, high = 0, len(ends)
    drawn = np.full(replicates, int(ends[-1]), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        start = int(ends[low - 1]) if low else 0
        share = (int(ends[middle - 1]) - start) / (int(ends[high - 1]) - start)
        left = np.random.default_rng([seed, 1, low, high]).binomial(drawn, share)
        if bucket < middle:
            drawn, high = left, middle
        else:
            drawn, low = drawn - left, middle
    return drawn


def cluster_bootstrap(df: DataFrame, cluster: str, horizon: int, replicates: int = 300, seed: int = 7, causes: int = 2, together: int = 2048) -> DataFrame:
    """mean, low, high, replicates of cause-1 incidence at a horizon when whole clusters are drawn with replacement, as many as there are.

    Clusters are dealt by hash to buckets of about ``together``. A bucket's task learns how many draws of each replicate are its own, draws them over its clusters,
    and adds the clusters' counts by time up as vectors over the replicates: no row is written once a replicate. The vectors of a time are added over the buckets, and
    what is left, times by replicates, is one small table. A null cluster is one of its own. df is read twice, for the names of its clusters and for their counts.
    """
    names = df.where(F.col("duration").isNotNull()).select(F.col(cluster).cast("string").alias("cluster")).distinct().persist()
    clusters = names.count()
    if not clusters:
        names.unpersist()
        return df.sparkSession.createDataFrame([(None, None, None, 0)], "mean double, low double, high double, replicates long")
    buckets = -(-clusters // together)
    bucket_of = F.pmod(F.xxhash64("cluster"), F.lit(buckets)).cast("int")
    sizes = np.zeros(buckets, np.int64)
    for bucket, n in names.groupBy(bucket_of.alias("bucket")).count().collect():  # a number for each bucket
        sizes[bucket] = n
    names.unpersist()
    dealt = cells_of(df, [cluster], horizon, causes).withColumn("cluster", F.col(cluster).cast("string")).select("cluster", "time", "kind", "count", bucket_of.alias("bucket"))
    ends = sizes.cumsum()
    schema = "time double, leaving array<long>, ended array<long>, first array<long>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        names, of = np.unique(pdf["cluster"].fillna("").to_numpy() + np.where(pdf["cluster"].isna(), "\0", ""), return_inverse=True)  # in one order whatever the rows'
        drawn = draws_of(bucket, ends, replicates, seed)
        weights = np.random.default_rng([seed, 2, bucket]).multinomial(drawn, np.full(len(names), 1 / len(names)))  # replicates x clusters
        out = []
        for time, rows in pdf.assign(of=of).groupby("time"):
            of, n, kind = rows["of"].to_numpy(), rows["count"].to_numpy(np.int64), rows["kind"].to_numpy()
            out.append((time, *((weights[:, of[some]] @ n[some]).tolist() for some in (kind >= 0, kind > 0, kind == 1))))
        return pd.DataFrame(out, columns=["time", "leaving", "ended", "first"])

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["time"].iloc[0], *(np.stack(pdf[c]).sum(0).tolist() for c in ("leaving", "ended", "first")))], columns=["time", "leaving", "ended", "first"])

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        return pd.DataFrame({"cif": incidences(*(np.stack(pdf[c]).T.astype(float) for c in ("leaving", "ended", "first")))})

    vectors = dealt.groupBy("bucket").applyInPandas(run, schema).groupBy("time").applyInPandas(summed, schema)
    each = vectors.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(curve, "cif double")  # a row for each time up to the horizon
    return each.agg(F.avg("cif").alias("mean"), F.percentile("cif", F.lit(0.025)).alias("low"), F.percentile("cif", F.lit(0.975)).alias("high"), F.count("*").alias("replicates"))
