"""Frames for forecasts: who can be labelled, what is known of them, and how many will be left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.stats import auc, quantiles


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, order: list[str], buckets: int = 32, most: int = 1_000_000, crowded: DataFrame | None = None) -> DataFrame:
    """Every row of left with the last row of right of its key at or before its time, by time and ``order``; nulls where there is none.

    Both sides are one sorted run a key, in which each question takes the last row that came before it: one shuffle, whatever the number of keys. The run of a key with more than
    ``most`` rows is cut at times that part its rows evenly, and every part begins with what the parts before it ended with; so such a key is as many tasks, and no pair of rows is made.
    ``crowded`` has these keys, a row each, where the caller finds them at less cost than by counting both sides; one too many or too few changes no row of the result.
    Null keys and times meet nothing.
    """
    extra = [c for c in right.columns if c != key]
    offered = right.select(F.col(key).alias("__key"), F.col(right_at).alias("__t"), F.struct(*extra).alias("__right")).where("__key is not null and __t is not null")
    asked = left.select(F.col(key).alias("__key"), F.col(at).alias("__t"), F.struct(*left.columns).alias("__left"))
    both = offered.withColumn("__left", F.lit(None).cast(asked.schema["__left"].dataType)).unionByName(asked, allowMissingColumns=True)
    if crowded is None:
        crowded = both.groupBy("__key").count().where(F.col("count") > most).select(F.col("__key").alias(key))
    crowded = crowded.select(F.col(key).alias("__key")).where("__key is not null")
    then = ["__t", F.col("__left").isNotNull(), *(F.col(f"__right.{c}") for c in order if c != key)]
    if crowded.isEmpty():
        whole, run = both, Window.partitionBy("__key").orderBy(*then)
    else:
        whole, run = in_parts(both, crowded, right.schema[right_at].dataType.typeName(), then, buckets), Window.partitionBy("__key", "__part").orderBy("__first", *then)
    asks = F.col("__left").isNotNull() & F.col("__key").isNotNull() & F.col("__t").isNotNull()
    met = whole.withColumn("__met", F.when(asks, F.last("__right", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))).where("__left is not null")
    return met.select(*(F.col(f"__left.{c}").alias(c) for c in left.columns), *(F.col(f"__met.{c}").alias(c) for c in extra))


def in_parts(both: DataFrame, crowded: DataFrame, kind: str, then: list, buckets: int) -> DataFrame:
    """both with __part, cut by time for crowded keys and 0 for others, and __first; with a row more for each part of a crowded key, what it is handed on."""
    number = F.unix_micros(F.col("__t").cast("timestamp")) if kind in {"date", "timestamp", "timestamp_ntz"} else F.col("__t")
    theirs = both.join(F.broadcast(crowded.distinct()), "__key")
    cuts = theirs.groupBy("__key").agg(F.array_distinct(F.percentile_approx(number, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(100 * buckets))).alias("__cuts"))
    cuts = both.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # a row a crowded key; they depend on the order of rows, and all that follows must have the same
    dealt = both.join(F.broadcast(cuts), "__key", "left").withColumn("__part", F.coalesce(F.size(F.filter(F.coalesce("__cuts", F.array().cast(cuts.schema["__cuts"].dataType)), lambda c: c < number)), F.lit(0)))
    # at most as many rows a crowded key as there are parts
    last = dealt.where("__cuts is not null and __right is not null").groupBy("__key", "__part").agg(F.max_by("__right", F.struct(*then)).alias("__right"))
    parts = dealt.where("__cuts is not null").select("__key", "__part").distinct().join(last, ["__key", "__part"], "left")
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select("__key", "__part", F.last("__right", ignorenulls=True).over(before).alias("__right")).where("__right is not null")
    return dealt.drop("__cuts").withColumn("__first", F.lit(1)).unionByName(handed.withColumn("__first", F.lit(0)), allowMissingColumns=True)


def exit_labels(df: DataFrame, days: str, event: str, window: int = 1095) -> DataFrame:
    """df with ``label``: 1 for an exit within the window, 0 for a life seen beyond it. Lives lost from sight within it have no label and go,
    and so do those with no or negative days."""
    exited = F.coalesce(F.col(event), F.lit(False)) & (F.col(days) <= window)
    return df.where((F.col(days) >= 0) & (exited | (F.col(days) > window))).withColumn("label", exited.cast("int"))


def exit_features(df: DataFrame, equity: str, cash: str, current: str, creditors: str, staff: str, most_staff: int = 100) -> DataFrame:
    """df with negative_equity, cash_share, negative_capital and log_staff; rows where one is not known go."""
    return df.withColumns({
        "negative_equity": (F.col(equity) < 0).cast("double"),
        "cash_share": F.when(F.col(current) > 0, F.col(cash) / F.col(current)),
        "negative_capital": (F.col(current) < F.col(creditors)).cast("double"),
        "log_staff": F.when(F.col(staff).isNotNull(), F.log1p(F.greatest(F.lit(0), F.least(F.col(staff), F.lit(most_staff))))),
    }).dropna(subset=["negative_equity", "cash_share", "negative_capital", "log_staff"])


def by_year(df: DataFrame, year: str, train: tuple[int, int], test: int) -> DataFrame:
    """df with ``part``, train or test, by the year; other years go."""
    part = F.when(F.col(year).between(*train), "train").when(F.col(year) == test, "test")
    return df.withColumn("part", part).where("part is not null")


def exit_frame(lives: DataFrame, accounts: DataFrame, entity: str, born: str, days: str, event: str, made_up: str, order: list[str], columns: dict[str, str], train: tuple[int, int], test: int, window: int = 1095, crowded: DataFrame | None = None) -> DataFrame:
    """What is known of each life when its window opens, and whether it exits within it: lives with acc_year, label, the four features, and part.

    The features are those of the entity's last accounts at or before ``born`` (never later ones), whose columns for equity, cash, current, creditors and staff
    ``columns`` names. Lives without accounts, label or a feature go, and so do those of other years. Accounts of years before the first one wanted can only meet
    lives that go, and hide no later ones, so they and the lives before that year do not go into the join; ``crowded`` is that of as_of.
    """
    opens = min(train[0], test)
    labelled = exit_labels(lives.where(F.year(born) >= opens), days, event, window)
    met = as_of(labelled, accounts.where(F.year(made_up) >= opens), entity, born, made_up, order, crowded=crowded).where(F.col(made_up).isNotNull()).withColumn("acc_year", F.year(made_up))
    framed = exit_features(met, *(columns[c] for c in ("equity", "cash", "current", "creditors", "staff")))
    return by_year(framed, "acc_year", train, test)


def deciles(df: DataFrame, score: str, label: str) -> DataFrame:
    """part (auc or decile), decile, n, value: the area under the curve by midranks, and the share of label 1 in each tenth of the scores; tenths that share an edge are one.

    The two columns are read several times, so they are kept while the eleven rows of the result are made.
    """
    rows = df.select(F.col(score).alias("score"), F.col(label).alias("y")).persist()
    a = auc(rows, "score", "y").select(F.lit("auc").alias("part"), F.lit(0).alias("decile"), (F.col("n1") + F.col("n0")).alias("n"), F.col("auc").alias("value"))
    names = [f"d{i}" for i in range(1, 10)]
    edges = quantiles(rows, [], "score", {c: i / 10 for i, c in enumerate(names, 1)}).select(F.array_distinct(F.array(*names)).alias("edges"))  # one row
    dealt = rows.crossJoin(F.broadcast(edges)).select("y", (1 + F.size(F.filter("edges", lambda e: e < F.col("score")))).alias("decile"))
    whole = a.unionByName(dealt.groupBy("decile").agg(F.lit("decile").alias("part"), F.count("*").alias("n"), F.avg("y").alias("value")))
    found = whole.collect()
    rows.unpersist()
    return df.sparkSession.createDataFrame(found, whole.schema)


def reached(curve: DataFrame, asked: DataFrame, groups: list[str], time: str) -> DataFrame:
    """asked with ``survival`` at its time: of the curve's last time up to it, 1 before the first.

    Both sides are one sorted run a group; its length is that of the curve and of the distinct times asked.
    """
    steps = curve.select(*groups, F.col("time").alias(time), F.lit(0).alias("asks"), "survival")
    times = asked.select(*groups, time).distinct().withColumns({"asks": F.lit(1), "survival": F.lit(None).cast("double")})
    run = Window.partitionBy(*groups).orderBy(time, "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = steps.unionByName(times).withColumn("survival", F.coalesce(F.last("survival", ignorenulls=True).over(run), F.lit(1.0)))
    return asked.join(met.where("asks = 1").drop("asks"), [*groups, time], "left")


def stock_projection(alive: DataFrame, entrants: DataFrame, curve: DataFrame, group: str, age: str = "age", years: int = 3, cap: int = 1825, scenarios: tuple[float, ...] = (0.9, 1.0, 1.1)) -> DataFrame:
    """group, year, scenario, projected: those alive, aged along the curve, and the entrants of each year from its middle on.

    alive: a row each, with its age in days; entrants: group and n a year; curve: of kaplan_meier by group. Beyond ``cap`` days the curve is flat.
    """
    counts = alive.groupBy(group, age).count().withColumn("year", F.explode(F.array(*map(F.lit, range(1, years + 1)))))
    now, then = F.least(F.col(age), F.lit(cap)).alias("at"), F.least(F.col(age) + 365 * F.col("year"), F.lit(cap)).alias("at")
    asked = counts.select(group, "year", age, "count", now, F.lit("now").alias("when")).unionByName(counts.select(group, "year", age, "count", then, F.lit("then").alias("when")))
    s = reached(curve, asked, [group], "at")
    each = s.groupBy(group, "year", age).agg(F.first("count").alias("n"), F.max(F.when(F.col("when") == "now", F.col("survival"))).alias("a"), F.max(F.when(F.col("when") == "then", F.col("survival"))).alias("b"))
    aged = each.groupBy(group, "year").agg(F.sum(F.col("n") * F.col("b") / F.greatest("a", F.lit(1e-9))).alias("aged"))
    middles = F.explode(F.transform(F.sequence(F.lit(0), F.col("year") - 1), lambda j: F.least(365 * (F.col("year") - j) - 182, F.lit(cap))))
    coming = entrants.withColumn("year", F.explode(F.array(*map(F.lit, range(1, years + 1))))).select(group, "year", F.col("n").alias("n_new"), middles.alias("at"))
    new = reached(curve, coming, [group], "at").groupBy(group, "year").agg(F.sum(F.col("n_new") * F.col("survival")).alias("new"))
    both = aged.join(new, [group, "year"], "full").withColumn("scenario", F.explode(F.array(*map(F.lit, scenarios))))
    total = F.coalesce("aged", F.lit(0.0)) + F.col("scenario") * F.coalesce("new", F.lit(0.0))
    return both.select(group, "year", "scenario", F.floor(total).alias("projected"))
