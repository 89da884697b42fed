"""Joins that a register needs: first within an interval, one of several keys, names by falling strictness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.normalise import company_name, sorted_tokens


def first_within(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, before: int, after: int, left_id: str, right_id: str) -> DataFrame:
    """left with the first row of right (by time, then id) of the same key from ``before`` to ``after`` around it, itself apart; nulls where there is none.

    Both are microseconds for dates and timestamps, and units of the column for whole numbers.

    Time is cut into buckets as wide as the interval. A right row lies in one bucket, a left row asks in the two at most that its interval
    touches, and one sorted run over a key's bucket hands every question the next right row: no pair of rows is made, and a key with many rows is spread over its buckets.
    Ids are distinct; null keys and times meet nothing.
    """
    width = before + after + 1
    moments = {"date", "timestamp", "timestamp_ntz"}
    micros = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) if df.schema[c].dataType.typeName() in moments else F.col(c).cast("long")
    extra = [c for c in right.columns if c != key]
    bucket = lambda t: F.floor(t / F.lit(width))
    offered = right.select(F.col(key).alias("__key"), micros(right, right_at).alias("__t"), F.col(right_id).alias("__id"), F.struct(*extra).alias("__right")).where("__key is not null and __t is not null")
    offered = offered.withColumn("__bucket", bucket(F.col("__t")))
    asked = left.select(F.col(key).alias("__key"), (micros(left, at) - before).alias("__t"), (micros(left, at) + after).alias("__until"), F.col(left_id).alias("__own")).where("__key is not null and __t is not null")
    asked = asked.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(F.col("__t")), bucket(F.col("__until"))))))
    rows = offered.unionByName(asked, allowMissingColumns=True)
    # from the latest to the earliest: what came last is next in time; a question stands before the rows of its own moment
    order = Window.partitionBy("__key", "__bucket").orderBy(F.desc("__t"), F.col("__own").isNotNull(), F.desc("__id"))
    row = F.when(F.col("__own").isNull(), F.struct("__t", "__id", "__right"))
    later = rows.withColumn("__next", F.last(row, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    both = F.when(F.col("__own").isNull(), F.struct(row.alias("first"), F.col("__next").alias("second")))
    found = later.withColumn("__both", F.last(both, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__own is not null")
    first = F.when(F.col("__both.first.__id").cast("string") == F.col("__own").cast("string"), F.col("__both.second")).otherwise(F.col("__both.first"))
    met = found.select("__own", "__until", first.alias("__first")).where("__first.__t <= __until")
    least = met.groupBy("__own").agg(F.min_by("__first.__right", F.struct("__first.__t", "__first.__id")).alias("__right"))
    return left.join(least, F.col(left_id) == F.col("__own"), "left").select(*left.columns, *(F.col(f"__right.{c}").alias(c) for c in extra))


def any_key_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_key: str) -> DataFrame:
    """Distinct pairs that agree in any of the left keys: one equi-join on exploded keys, where an OR would be a nested loop."""
    keys = F.array_distinct(F.filter(F.array(*(F.col(c) for c in left_keys)), lambda k: k.isNotNull() & (k != "")))
    return left.withColumn("__key", F.explode(keys)).drop(*left_keys).join(right, F.col("__key") == F.col(right_key)).drop("__key").distinct()


def part_keys(n: Column, edits: int) -> Column:
    """Keys of a register name for up to ``edits`` edits: its length and one of edits + 1 parts of it, cut by position."""
    size, parts = F.length(n), edits + 1

    def key(i: Column) -> Column:
        at = F.floor(size * i / parts).cast("int")
        text = F.substring(n, at + 1, F.floor(size * (i + 1) / parts).cast("int") - at)
        return F.concat_ws(":", F.lit("3"), F.lit(edits), size, i, text)

    return F.transform(F.sequence(F.lit(0), F.lit(edits)), key)


def probe_keys(n: Column, edits: int) -> Column:
    """Keys of a query name that meet ``part_keys`` of every name within ``edits`` edits.

    As many edits leave one of edits + 1 parts as it is, moved by ``edits`` places at most, and change the length by as many.
    """
    size, parts = F.length(n), edits + 1
    moves = F.sequence(F.lit(-edits), F.lit(edits))

    def of_part(length: Column, i: Column) -> Column:
        first = F.floor(length * i / parts).cast("int")
        width = F.floor(length * (i + 1) / parts).cast("int") - first
        starts = F.filter(F.transform(moves, lambda m: first + m), lambda at: (at >= 0) & (at + width <= size))
        return F.transform(starts, lambda at: F.concat_ws(":", F.lit("3"), F.lit(edits), length, i, F.substring(n, at + 1, width)))

    lengths = F.filter(F.transform(moves, lambda m: size + m), lambda length: length >= 0)
    of_length = lambda length: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), lambda i: of_part(length, i)))
    return F.flatten(F.transform(lengths, of_length))


def dealt_blocks(asked: DataFrame, offered: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``chunk``: what is offered under a key that has more than ``most`` rows is dealt into chunks by hash, and what asks for it meets each of them."""
    sizes = offered.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / most).cast("int").alias("__chunks"))
    one = offered.join(sizes, key, "left").withColumn("chunk", F.pmod(F.xxhash64(*offered.columns), F.coalesce("__chunks", F.lit(1))).cast("int")).drop("__chunks")
    two = asked.join(sizes, key, "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("__chunks", F.lit(1)) - 1))).drop("__chunks")
    return two, one


def name_tiers(queries: DataFrame, register: DataFrame, query: str, name: str, tie: list[Column], most: int = 1000) -> DataFrame:
    """The best match of each query name: T1 equal, T2 equal without brackets, T3 within one or two edits, T4 equal sorted tokens.

    Candidates share a blocking key (the name, the name without brackets, the sorted tokens, or a part of the name at about its
    place), so no query meets the whole register, and each pair that a tier fits shares one. Rows of one name meet as one, and a block of
    more than ``most`` names (a part that many names have) is dealt to several tasks. The first tier with hits decides, then the tie order.
    """
    bare = lambda c: company_name(F.regexp_replace(c, r"\([^)]*\)", " "))
    q = queries.select(query, company_name(F.col(query)).alias("qn"), bare(F.col(query)).alias("qb")).distinct()
    r = register.distinct().select("*", company_name(F.col(name)).alias("rn"), bare(F.col(name)).alias("rb"))
    names = r.groupBy("rn", "rb").agg(F.count("*").alias("__n"))
    exact = lambda n, b: F.array(F.concat(F.lit("1="), n), F.concat(F.lit("2="), b), F.concat(F.lit("4="), sorted_tokens(n)))
    qn, rn = F.col("qn"), F.col("rn")
    near = F.when(F.length(qn) > 12, probe_keys(qn, 2)).otherwise(probe_keys(qn, 1))
    asked = q.withColumn("block", F.explode(F.array_distinct(F.concat(exact(qn, F.col("qb")), near))))
    offered = names.withColumn("block", F.explode(F.array_distinct(F.concat(exact(rn, F.col("rb")), part_keys(rn, 1), part_keys(rn, 2)))))
    limit = F.when(F.length("qn") > 12, 2).otherwise(1)
    tier = (
        F.when(F.col("qn") == F.col("rn"), 1).when(F.col("qb") == F.col("rb"), 2)
        .when(F.levenshtein("qn", "rn", 2).between(0, limit), 3).when(sorted_tokens(F.col("qn")) == sorted_tokens(F.col("rn")), 4)
    )
    asked, offered = dealt_blocks(asked, offered, "block", most)
    met = asked.join(offered, ["block", "chunk"]).withColumn("tier", tier).where("tier is not null").select(query, "rn", "rb", "tier", "__n").distinct()
    least = F.min("tier").over(Window.partitionBy(query))
    met = met.withColumn("__least", least).where(F.col("tier") == F.col("__least")).withColumn("candidates", F.sum("__n").over(Window.partitionBy(query))).drop("__least", "__n")
    of_name = F.row_number().over(Window.partitionBy("rn", "rb").orderBy(*tie))
    first = r.withColumn("__rank", of_name).where("__rank = 1").drop("__rank")
    best = F.row_number().over(Window.partitionBy(query).orderBy(*tie))
    return met.join(first, ["rn", "rb"]).withColumn("__rank", best).where("__rank = 1").drop("__rank", "rn", "rb")


def overlap_score(a: Column, b: Column, stop: list[str]) -> Column:
    """Shared tokens over the smaller set, stop words apart; 0 if either is empty."""
    x, y = (F.array_except(F.array_distinct(F.split(F.lower(c), r"\s+")), F.array(*map(F.lit, [*stop, ""]))) for c in (a, b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
