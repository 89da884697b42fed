"""What the query modules share: the registers, the tables and the life view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.classify import ERAS, era
from quarrystone.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ERA_SQL = "case " + " ".join(f"when born between date '{a}' and date '{b}' then '{n}'" for n, a, b in ERAS) + " end"
LIFE_SQL = f"""
life0 as (select l_orderkey, l_partkey, l_suppkey, o_custkey, cast(o_orderdate as date) as born, cast(l_shipdate as date) as died,
  date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as duration, case when l_linestatus = 'F' then 1 else 0 end as event,
  case l_returnflag when 'R' then 1 when 'A' then 2 else 0 end as cause,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'counter' else 'service' end as format, l_extendedprice
  from lineitem join orders on l_orderkey = o_orderkey),
life as (select *, {ERA_SQL} as era from life0 where duration >= 0)"""
KM_SQL = """
{n}_c as (select {g}, duration as time, sum(event) as deaths, count(*) as leaving from {src} group by all),
{n}_r as (select *, sum(leaving) over (partition by {g} order by time desc rows unbounded preceding) as n from {n}_c),
{n}_s as (select {g}, time, n, deaths, product(1 - deaths / n) over (partition by {g} order by time rows unbounded preceding) as survival,
  sum(case when n > deaths then deaths / (n * (n - deaths)) end) over (partition by {g} order by time rows unbounded preceding) as green from {n}_r where deaths > 0),
{n} as (select {g}, time, n, deaths, survival, survival * survival * coalesce(green, 0) as variance from {n}_s)"""


def km_sql(name: str, source: str, groups: str) -> str:
    return KM_SQL.format(n=name, src=source, g=groups)


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL if it has one."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def life(spark: SparkSession, d: str) -> DataFrame:
    """One row for each line of an order that ships after it: duration in days, event, cause, format, era."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    born, died = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    rows = joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "o_custkey", born.alias("born"), died.alias("died"), F.datediff(died, born).alias("duration"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("event"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("cause"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "counter").otherwise("service").alias("format"), "l_extendedprice",
    )
    return rows.where("duration >= 0").withColumn("era", era(F.col("born")))


def r6(c) -> F.Column:
    return F.round(c, 6)
