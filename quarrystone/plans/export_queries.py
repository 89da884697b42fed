"""The published result tables on the stand-in cohort: the life view with the nation of its customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions import classify
from quarrystone.operators import stats, survival
from quarrystone.plans.base import ERA_SQL, LIFE_SQL, km_sql, life, query, r6
from quarrystone.plans.relational_queries import SUCCESSION_SQL, growth, succession
from quarrystone.plans.survival_queries import AT
from quarrystone.session import table

C = F.col
COHORT_SQL = f"""{LIFE_SQL},
cohort as (select life.*, n_name as nation, case cause when 1 then 'failing' when 2 then 'closing' else 'alive' end as outcome, {ERA_SQL.replace('born', 'died')} as death_era from life join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def cohort(s, d):
    rows = life(s, d).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey")).join(table(s, d, "nation").select("n_nationkey", C("n_name").alias("nation")), C("c_nationkey") == C("n_nationkey"))
    return rows.withColumns({"outcome": F.when(C("cause") == 1, "failing").when(C("cause") == 2, "closing").otherwise("alive"), "death_era": classify.era(C("died"))})


#: name: (keys, filter), in SQL that both engines read.
COUNTS = {
    "Q60_openings_by_year_format": ("cast(year(born) as int) as year, format", "true"),
    "Q61_openings_by_year_segment": ("cast(year(born) as int) as year, l_suppkey % 7 as sic", "true"),
    "Q62_openings_by_nation_era": ("nation, era", "era is not null"),
    "Q63_closures_by_year_format": ("cast(year(died) as int) as year, format", "event = 1"),
    "Q64_closures_by_nation_era": ("nation, death_era", "event = 1 and death_era is not null"),
    "Q65_outcomes_by_format": ("format, outcome", "true"),
    "Q66_outcomes_by_nation": ("nation, outcome", "true"),
    "Q77_routes_by_format": ("format, case cause when 1 then 'court' when 2 then 'voluntary' else 'none' end as route", "event = 1"),
    "Q78_routes_by_era": ("death_era, case cause when 1 then 'court' when 2 then 'voluntary' else 'none' end as route", "event = 1"),
}


def count_query(name: str, keys: str, where: str) -> None:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(keys + ","):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(keys[start:i].strip())
            start = i + 1

    @query(name, f"with {COHORT_SQL} select {keys}, count(*) as n from cohort where {where} group by all")
    def run(s, d):
        named = cohort(s, d).where(where).select(*map(F.expr, parts))
        return named.groupBy(*named.columns).agg(F.count("*").alias("n"))


for _name, (_keys, _where) in COUNTS.items():
    count_query(_name, _keys, _where)


QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


@query("Q67_lifespan_summary", f"with {COHORT_SQL} select format, count(*) as n, round(median(duration / 365.25), 6) as median, round(quantile_cont(duration / 365.25, 0.25), 6) as q1, round(quantile_cont(duration / 365.25, 0.75), 6) as q3, round(min(duration / 365.25), 6) as low, round(max(duration / 365.25), 6) as high, round(avg(duration / 365.25), 6) as mean from cohort where event = 1 group by 1")
def q67(s, d):
    rows = cohort(s, d).where("event = 1").withColumn("y", C("duration") / F.lit(365.25))
    rest = rows.groupBy("format").agg(F.count("*").alias("n"), r6(F.min("y")).alias("low"), r6(F.max("y")).alias("high"), r6(F.avg("y")).alias("mean"))
    return rest.join(stats.quantiles(rows, ["format"], "y", QUARTILES).drop("n"), "format").select("format", "n", *(r6(c).alias(c) for c in QUARTILES), "low", "high", "mean")


@query("Q68_lifespan_buckets", f"with {COHORT_SQL} select format, case when duration < 365 then 'under 1' when duration < 1095 then '1 to 3' when duration < 1825 then '3 to 5' else 'over 5' end as bucket, count(*) as n from cohort where event = 1 group by all")
def q68(s, d):
    x = C("duration")
    return cohort(s, d).where("event = 1").groupBy("format", F.when(x < 365, "under 1").when(x < 1095, "1 to 3").when(x < 1825, "3 to 5").otherwise("over 5").alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "Q69_net_churn",
    f"""with {COHORT_SQL}, o as (select nation, year(born) as year, format, count(*) as openings from cohort group by all), c as (select nation, year(died) as year, format, count(*) as closures from cohort where event = 1 group by all)
 select coalesce(o.nation, c.nation) as nation, cast(coalesce(o.year, c.year) as int) as year, coalesce(o.format, c.format) as format, coalesce(openings, 0) as openings, coalesce(closures, 0) as closures, coalesce(openings, 0) - coalesce(closures, 0) as net
 from o full join c on o.nation = c.nation and o.year = c.year and o.format = c.format""",
)
def q69(s, d):
    rows = cohort(s, d)
    o = rows.groupBy("nation", F.year("born").alias("year"), "format").agg(F.count("*").alias("openings"))
    c = rows.where("event = 1").groupBy("nation", F.year("died").alias("year"), "format").agg(F.count("*").alias("closures"))
    return o.join(c, ["nation", "year", "format"], "full").fillna(0, ["openings", "closures"]).withColumn("net", C("openings") - C("closures"))


@query("Q70_succession_matrix", f"with {SUCCESSION_SQL} select transition, count(*) as n from succession group by 1")
def q70(s, d):
    return succession(s, d).groupBy("transition").agg(F.count("*").alias("n"))


@query("Q71_succession_by_user_group", f"with {SUCCESSION_SQL} select user_id % 10 as grp, count(*) as n, count(*) filter (went_dark) as dark from succession group by 1")
def q71(s, d):
    return succession(s, d).groupBy((C("user_id") % 10).alias("grp")).agg(F.count("*").alias("n"), F.count_if("went_dark").alias("dark"))


@query("Q72_succession_gaps", f"with {SUCCESSION_SQL} select transition, count(*) as n, round(median(gap), 3) as median, round(quantile_cont(gap, 0.25), 3) as q1, round(quantile_cont(gap, 0.75), 3) as q3 from succession where not went_dark group by 1")
def q72(s, d):
    return stats.quantiles(succession(s, d).where("not went_dark"), ["transition"], "gap", QUARTILES).select("transition", "n", *(F.round(c, 3).alias(c) for c in QUARTILES))


@query("Q73_successor_industries", f"with {SUCCESSION_SQL} select industry, count(*) as n from succession where not went_dark group by 1")
def q73(s, d):
    return succession(s, d).where("not went_dark").groupBy("industry").agg(F.count("*").alias("n"))


@query("Q74_top_keys", "select l_partkey, count(*) as n, min(l_shipdate) as example from lineitem group by 1 order by n desc, l_partkey limit 60")
def q74(s, d):
    return table(s, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("example")).orderBy(F.desc("n"), "l_partkey").limit(60)


@query("Q75_cohort_by_nation", f"with {COHORT_SQL} select nation, count(*) as n, count(*) filter (event = 1) as ended, count(*) filter (format = 'counter') as counter, count(*) filter (cause = 1) as failed from cohort group by 1")
def q75(s, d):
    return cohort(s, d).groupBy("nation").agg(F.count("*").alias("n"), F.count_if(C("event") == 1).alias("ended"), F.count_if(C("format") == "counter").alias("counter"), F.count_if(C("cause") == 1).alias("failed"))


@query("Q76_flow_sorted", "select 'events' as step, event_type as stage, count(*) as n from events group by 2 order by n desc, stage")
def q76(s, d):
    return table(s, d, "events").groupBy(F.lit("events").alias("step"), C("event_type").alias("stage")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stage")


#: Readings of the cohort: which rows count.
READINGS = {"A": "true", "B": "l_suppkey % 4 <> 0", "C": "l_extendedprice > 10000"}
RANKS_SQL = (
    f"with {COHORT_SQL}, v as ("
    + " union all ".join(f"select '{k}' as reading, * from cohort where {p}" for k, p in READINGS.items())
    + f"), {km_sql('km', 'v', 'reading, nation')}, atx as ({AT.format(g='reading, nation', src='km')}), "
    + "big as (select reading, nation from v group by all having count(*) >= 10), s as (select reading, nation, survival from atx join big using (reading, nation) where horizon = 1095), "
    + "r as (select *, rank() over (partition by reading order by round(survival, 9) desc) as rnk from s), w as (select nation, max(rnk) filter (reading = 'A') as a, max(rnk) filter (reading = 'B') as b, max(rnk) filter (reading = 'C') as c from r group by 1)"
)


def readings(s, d):
    """nation and its rank by three-year survival in each reading; null below the floor of ten."""
    flags = F.filter(F.array(*(F.when(F.expr(p), F.lit(k)) for k, p in READINGS.items())), lambda x: x.isNotNull())
    v = cohort(s, d).withColumn("reading", F.explode(flags))
    big = v.groupBy("reading", "nation").count().where("count >= 10").select("reading", "nation")
    at = survival.survival_at(survival.kaplan_meier(v, ["reading", "nation"]), ["reading", "nation"], [1095]).join(big, ["reading", "nation"])
    r = at.withColumn("rank", F.rank().over(Window.partitionBy("reading").orderBy(F.round("survival", 9).desc())))
    return r.groupBy("nation").pivot("reading", list(READINGS)).agg(F.max("rank"))


@query("Q48_rank_reversal", RANKS_SQL + " select count(*) as n, " + ", ".join(f"count(*) filter (abs(a - b) >= {k}) as ab_{k}, count(*) filter (abs(a - c) >= {k}) as ac_{k}" for k in (1, 3, 5, 10)) + ", max(abs(a - b)) as max_ab, max(abs(a - c)) as max_ac from w")
def q48(s, d):
    ab, ac = F.abs(C("A") - C("B")), F.abs(C("A") - C("C"))
    return readings(s, d).agg(F.count("*").alias("n"), *(f for k in (1, 3, 5, 10) for f in (F.count_if(ab >= k).alias(f"ab_{k}"), F.count_if(ac >= k).alias(f"ac_{k}"))), F.max(ab).alias("max_ab"), F.max(ac).alias("max_ac"))


@query(
    "Q48b_spearman_kendall",
    RANKS_SQL
    + """, x as (select nation, a, b from w where a is not null and b is not null), l as (select *, count(*) over (order by a range unbounded preceding) as ra, count(*) over (order by b range unbounded preceding) as rb from x)
 select n, round(1 - 6 * d2 / (n * (n * n - 1)), 6) as spearman, round(k, 6) as kendall from (select count(*) as n, cast(sum((ra - rb) * (ra - rb)) as double) as d2 from l) cross join (select avg(cast(sign(p.a - q.a) * sign(p.b - q.b) as double)) as k from x p join x q on p.nation < q.nation)""",
)
def q48b(s, d):
    x = readings(s, d).where("A is not null and B is not null").select("nation", C("A").alias("a"), C("B").alias("b"))
    return stats.spearman_kendall(x, "nation", "a", "b").select("n", r6("spearman").alias("spearman"), r6("kendall").alias("kendall"))


@query("Q58_group_json", f"with {COHORT_SQL} select nation, to_json({{'n': count(*), 'failed': count(*) filter (cause = 1)}}) as payload from cohort group by 1")
def q58(s, d):
    return cohort(s, d).groupBy("nation").agg(F.count("*").alias("n"), F.count_if(C("cause") == 1).alias("failed")).select("nation", F.to_json(F.struct("n", "failed")).alias("payload"))


@query(
    "Q59_nation_sheet",
    RANKS_SQL + """, g as (select c_nationkey, count(*) as customers, round(avg(c_acctbal), 4) as balance from customer group by 1)
 select n_name as nation, coalesce(customers, 0) as customers, balance, case when a is not null and b is not null and c is not null then a end as rank_a from nation left join g on n_nationkey = c_nationkey left join w on n_name = w.nation""",
)
def q59(s, d):
    """A row for each nation whatever the facts hold; a rank only above the floor in all readings."""
    g = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))
    rows = table(s, d, "nation").join(g, C("n_nationkey") == C("c_nationkey"), "left").join(readings(s, d), C("n_name") == C("nation"), "left")
    whole = C("A").isNotNull() & C("B").isNotNull() & C("C").isNotNull()
    return rows.select(C("n_name").alias("nation"), F.coalesce("customers", F.lit(0)).alias("customers"), "balance", F.when(whole, C("A")).alias("rank_a"))


@query("Q80_growth_by_sign", """with y as (select o_custkey, year(o_orderdate) as y, sum(o_totalprice) as v from orders group by all), l as (select *, lag(v) over w as pv, lag(y) over w as py from y window w as (partition by o_custkey order by y)),
 g as (select o_custkey, v / pv - 1 as g from l where py = y - 1 and pv > 1000), b as (select quantile_cont(g, 0.01) as lo, quantile_cont(g, 0.99) as hi from g), c as (select o_custkey, least(greatest(g, lo), hi) as g from g cross join b)
 select c_acctbal < 0 as negative, count(*) as n, round(median(g), 6) as median, round(avg(case when g > 0 then 1.0 else 0.0 end), 6) as positive from c join customer on o_custkey = c_custkey group by 1""")
def q80(s, d):
    rows = growth(s, d).join(table(s, d, "customer"), C("o_custkey") == C("c_custkey"))
    rows = rows.withColumn("negative", C("c_acctbal") < 0)
    rest = rows.groupBy("negative").agg(F.count("*").alias("n"), r6(F.avg((C("g") > 0).cast("double"))).alias("positive"))
    return rest.join(stats.quantiles(rows, ["negative"], "g", {"median": 0.5}).drop("n"), "negative").select("negative", "n", r6("median").alias("median"), "positive")
