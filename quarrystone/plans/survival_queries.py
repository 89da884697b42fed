"""Survival, competing risks and resampling over the life view."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import stats, survival
from quarrystone.plans.base import LIFE_SQL, km_sql, life, query, r6

AT = """select {g}, horizon, coalesce(arg_max(survival, time) filter (time <= horizon), 1.0) as survival, coalesce(arg_max(variance, time) filter (time <= horizon), 0.0) as variance
 from {src} cross join (select unnest([365, 730, 1095]) as horizon) group by all"""


@query("Q40_km_curve", f"with {LIFE_SQL}, {km_sql('km', 'life', 'format')} select format, time, cast(n as bigint) as n, cast(deaths as bigint) as deaths, round(survival, 6) as survival, round(variance, 9) as variance from km")
def q40(s, d):
    return survival.kaplan_meier(life(s, d), ["format"]).select("format", "time", "n", "deaths", r6("survival").alias("survival"), F.round("variance", 9).alias("variance"))


VARIANTS = {"all": "true", "early_born": "era in ('early', 'growth')", "single_supplier": "l_suppkey % 2 = 0", "dear": "l_extendedprice > 30000"}


@query(
    "Q41_survival_at_variants",
    f"with {LIFE_SQL}, v as (" + " union all ".join(f"select '{k}' as variant, life.* from life where {p}" for k, p in VARIANTS.items()) + f"), {km_sql('km', 'v', 'variant, format')}, big as (select variant, format, count(*) as n from v group by all having count(*) >= 10), a as ({AT.format(g='variant, format', src='km')}) select variant, format, horizon, n, round(survival, 6) as survival from a join big using (variant, format)",
)
def q41(s, d):
    flags = F.filter(F.array(*(F.when(F.expr(p), F.lit(k)) for k, p in VARIANTS.items())), lambda x: x.isNotNull())
    v = life(s, d).withColumn("variant", F.explode(flags))
    big = v.groupBy("variant", "format").agg(F.count("*").alias("n")).where("n >= 10")
    at = survival.survival_at(survival.kaplan_meier(v, ["variant", "format"]), ["variant", "format"], [365, 730, 1095])
    return at.join(big, ["variant", "format"]).select("variant", "format", "horizon", "n", r6("survival").alias("survival"))


@query(
    "Q42_km_ci_and_median",
    f"""with {LIFE_SQL}, {km_sql('km', 'life', 'format')}, a as ({AT.format(g='format', src='km')}), m as (select format, min(time) filter (survival <= 0.5) as median from km group by all),
 x as (select *, survival <= 0 or survival >= 1 or variance <= 0 as flat from a), y as (select *, case when flat then 0.5 else survival end as s from x)
 select format, horizon, round(survival, 6) as survival, round(case when flat then survival else pow(s, exp(1.96 * sqrt(variance) / abs(s * ln(s)))) end, 6) as low,
 round(case when flat then survival else pow(s, exp(-1.96 * sqrt(variance) / abs(s * ln(s)))) end, 6) as high, median from y join m using (format)""",
)
def q42(s, d):
    curve = survival.kaplan_meier(life(s, d), ["format"])
    low, high = survival.loglog_interval(F.col("survival"), F.col("variance"))
    at = survival.survival_at(curve, ["format"], [365, 730, 1095])
    return at.join(F.broadcast(survival.median_survival(curve, ["format"])), "format").select("format", "horizon", r6("survival").alias("survival"), r6(low).alias("low"), r6(high).alias("high"), "median")


LOGRANK = """c as (select {g} duration as time, sum(event) as d, sum(event * a) as d1, count(*) as x, sum(a) as x1 from (select *, case when format = 'counter' then 1 else 0 end as a from life) group by all),
 r as (select *, sum(x) over ({p} order by time desc rows unbounded preceding) as n, sum(x1) over ({p} order by time desc rows unbounded preceding) as n1 from c),
 s as (select {g} sum(d1) as o, sum(d * n1 / n) as e, sum(d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)) as v from r where d > 0 and n > 1 group by all)"""


@query("Q43_logrank", f"with {LIFE_SQL}, {LOGRANK.format(g='', p='').replace('n > 1 group by all', 'n > 1')} select cast(o as bigint) as observed, round(e, 4) as expected, round(v, 4) as variance, round((o - e) * (o - e) / v, 4) as chi2 from s")
def q43(s, d):
    sums = survival.logrank_sums(life(s, d).withColumn("one", F.lit(1)), ["one"], F.col("format") == "counter")
    o, e, v = F.col("observed"), F.col("expected"), F.col("variance")
    return sums.select(o.alias("observed"), F.round(e, 4).alias("expected"), F.round(v, 4).alias("variance"), F.round((o - e) * (o - e) / v, 4).alias("chi2"))


@query(
    "Q44_stratified_logrank",
    f"with {LIFE_SQL}, {LOGRANK.format(g='era, hub,', p='partition by era, hub').replace('from life)', 'from (select *, l_suppkey % 3 = 0 as hub from life where era is not null))')}, big as (select era, l_suppkey % 3 = 0 as hub, count(*) filter (format = 'counter') as n1, count(*) filter (format <> 'counter') as n0 from life where era is not null group by all) select count(*) as strata, cast(sum(o) as bigint) as observed, round(sum(e), 4) as expected, round(sum(v), 4) as variance, round(pow(sum(o) - sum(e), 2) / sum(v), 4) as chi2 from s join big using (era, hub) where n1 >= 25 and n0 >= 25",
)
def q44(s, d):
    rows = life(s, d).where("era is not null").withColumn("hub", F.col("l_suppkey") % 3 == 0)
    arm = F.col("format") == "counter"
    big = rows.groupBy("era", "hub").agg(F.count_if(arm).alias("n1"), F.count_if(~arm).alias("n0")).where("n1 >= 25 and n0 >= 25")
    sums = survival.logrank_sums(rows, ["era", "hub"], arm).join(F.broadcast(big), ["era", "hub"])
    o, e, v = F.sum("observed"), F.sum("expected"), F.sum("variance")
    return sums.agg(F.count("*").alias("strata"), o.alias("observed"), F.round(e, 4).alias("expected"), F.round(v, 4).alias("variance"), F.round(F.pow(o - e, F.lit(2)) / v, 4).alias("chi2"))


CAUSES = {"as_known": "cause", "unknown_to_1": "case when cause = 2 and l_suppkey % 5 = 0 then 1 else cause end", "unknown_to_0": "case when cause = 2 and l_suppkey % 5 = 0 then 0 else cause end", "unknown_apart": "case when cause = 2 and l_suppkey % 5 = 0 then 9 else cause end"}


@query(
    "Q45_cumulative_incidence",
    f"with {LIFE_SQL}, v as ("
    + " union all ".join(f"select '{k}' as variant, format, duration, {e} as cause from life" for k, e in CAUSES.items())
    + """), c as (select variant, format, duration as time, count(*) as x, count(*) filter (cause in (1, 2)) as ended, count(*) filter (cause = 1) as d1, count(*) filter (cause = 2) as d2 from v group by all),
 r as (select *, sum(x) over (partition by variant, format order by time desc rows unbounded preceding) as n from c),
 s as (select *, product(1 - ended / n) over (partition by variant, format order by time rows unbounded preceding) as survival from r where ended > 0),
 b as (select *, lag(survival, 1, 1.0) over (partition by variant, format order by time) as before from s)
 select variant, format, round(sum(before * d1 / n), 6) as cif_1, round(sum(before * d2 / n), 6) as cif_2 from b where time <= 1095 group by all""",
)
def q45(s, d):
    rows = life(s, d).withColumn("v", F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.expr(e).alias("cause")) for k, e in CAUSES.items()))))
    rows = rows.select("format", "duration", "v.variant", F.col("v.cause").alias("cause"))
    at = survival.cif_at(survival.cumulative_incidence(rows, ["variant", "format"]), ["variant", "format"], 1095)
    return at.select("variant", "format", r6("cif_1").alias("cif_1"), r6("cif_2").alias("cif_2"))


@query("Q46_person_period", f"with {LIFE_SQL}, p as (select format, k, case when duration < k * 365 and event = 1 then 1 else 0 end as hit from life cross join (select unnest([1, 2, 3, 4, 5]) as k) where duration >= (k - 1) * 365) select format, k, count(*) as at_risk, cast(sum(hit) as bigint) as events from p group by all")
def q46(s, d):
    return person_periods(life(s, d)).groupBy("format", "k").agg(F.count("*").alias("at_risk"), F.sum("hit").cast("long").alias("events"))


def person_periods(rows):
    """A row for each year k that a life begins; hit if it ends by an event within that year."""
    years = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(5), F.floor(F.col("duration") / 365).cast("int") + 1))))
    return years.withColumn("hit", F.when((F.col("duration") < F.col("k") * 365) & (F.col("event") == 1), 1).otherwise(0))


@query("Q46r_hazard_logit")
def q46r(s, d):
    """Discrete-time hazard: binomial regression on counts by cell, so the fit sees a few rows whatever the table's size."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    cells = person_periods(life(s, d)).groupBy("k", (F.col("format") == "counter").cast("int").alias("counter"), "hit").count()
    cells = cells.select("hit", "count", "counter", *((F.col("k") == k).cast("int").alias(f"k{k}") for k in range(2, 6)))
    names = ["counter", "k2", "k3", "k4", "k5"]
    fit = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="hit", weightCol="count", maxIter=25, tol=1e-10).fit(VectorAssembler(inputCols=names, outputCol="features").transform(cells.coalesce(1)))
    errors = fit.summary.coefficientStandardErrors
    rows = [(n, float(b), float(e)) for n, b, e in zip([*names, "intercept"], [*fit.coefficients, fit.intercept], errors)]
    out = s.createDataFrame(rows, "term string, coefficient double, error double")
    c, e = F.col("coefficient"), F.col("error")
    return out.select("term", c, e, F.exp(c).alias("odds_ratio"), F.exp(c - 1.96 * e).alias("low"), F.exp(c + 1.96 * e).alias("high"))


@query("Q47r_bootstrap_cif")
def q47(s, d):
    """The four columns are read several times, so they are kept while the two rows of the result are made."""
    rows = life(s, d).select("format", "l_suppkey", "duration", "cause").persist()
    a = survival.bootstrap_cif_difference(rows, "format", 1095).drop("first", "second").withColumn("method", F.lit("rows"))
    b = survival.cluster_bootstrap(rows, "l_suppkey", 1095).withColumnRenamed("mean", "difference").withColumn("method", F.lit("clusters"))
    both = a.unionByName(b)
    found = both.collect()
    rows.unpersist()
    return s.createDataFrame(found, both.schema)


@query("Q49r_clopper_pearson")
def q49(s, d):
    k = life(s, d).groupBy("format", "era").agg(F.count_if(F.col("cause") == 1).alias("k"), F.count("*").alias("n"))
    return stats.clopper_pearson(k, "k", "n")


@query(
    "Q21_first_order_survival",
    """with f as (select o_custkey, min(cast(o_orderdate as date)) as first_day from orders group by all), j as (select o.o_custkey, o.o_orderkey, first_day from orders o join f on o.o_custkey = f.o_custkey and cast(o_orderdate as date) = first_day),
 x as (select 'all' as g, date_diff('day', first_day, cast(l_shipdate as date)) as duration, case when l_linestatus = 'F' then 1 else 0 end as event from j join lineitem on l_orderkey = o_orderkey),
 life as (select * from x where duration >= 0), """ + km_sql("km", "life", "g") + ", a as (" + AT.format(g="g", src="km") + ") select horizon, round(survival, 6) as survival from a",
)
def q21(s, d):
    from quarrystone.session import table

    orders = table(s, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    first = orders.groupBy("o_custkey").agg(F.min("day").alias("day"))
    rows = orders.join(first, ["o_custkey", "day"]).join(table(s, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.lit("all").alias("g"), F.datediff(F.to_date("l_shipdate"), F.col("day")).alias("duration"), (F.col("l_linestatus") == "F").cast("int").alias("event")).where("duration >= 0")
    return survival.survival_at(survival.kaplan_meier(rows, ["g"]), ["g"], [365, 730, 1095]).select("horizon", r6("survival").alias("survival"))
