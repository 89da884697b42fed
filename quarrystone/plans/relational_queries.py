"""Projections, filters, joins, aggregates, windows, sorts and set operations on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions import classify
from quarrystone.operators import linkage, stats
from quarrystone.plans.base import ERA_SQL, LIFE_SQL, life, query, r6
from quarrystone.session import table

C = F.col


@query(
    "Q01_scan_slots",
    """with w as (select doc_id, string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' ') as raw, text from documents),
 s as (select doc_id, list_filter(raw, lambda x: x <> '')[1:4] as slots, nullif(regexp_extract(text, '^\\s*([A-Z][a-z]+)', 1), '') as lead from w),
 f as (select *, list_filter(slots, lambda x: lower(x) in ('the', 'of', 'to', 'de', 'der', 'la'))[1] as chosen from s)
 select doc_id, lead, chosen, len(list_distinct(list_transform(slots, lambda x: length(x) > 3))) > 1 as mixed, array_to_string(slots, ';') as all_slots,
 try_cast(try_strptime(case doc_id % 3 when 0 then '02/01/2020' when 1 then '2/1/2020' else '31/02/2020' end, '%d/%m/%Y') as date) as incorporated from f""",
)
def q01(s, d):
    words = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " "), lambda x: x != "")
    docs = table(s, d, "documents").select("doc_id", F.slice(words, 1, 4).alias("slots"), "text")
    day = F.when(C("doc_id") % 3 == 0, "02/01/2020").when(C("doc_id") % 3 == 1, "2/1/2020").otherwise("31/02/2020")
    first = F.get(F.filter("slots", lambda x: F.lower(x).isin("the", "of", "to", "de", "der", "la")), F.lit(0))
    return docs.select("doc_id", F.nullif(F.regexp_extract("text", r"^\s*([A-Z][a-z]+)", 1), F.lit("")).alias("lead"), first.alias("chosen"), (F.size(F.array_distinct(F.transform("slots", lambda x: F.length(x) > 3))) > 1).alias("mixed"), F.array_join("slots", ";").alias("all_slots"), F.try_to_date(day, "d/M/yyyy").alias("incorporated"))


@query("Q02_scope_filter", "select o_orderkey, o_totalprice from orders where o_orderstatus in ('F', 'O') and o_totalprice between 1000 and 400000 and not o_orderpriority = '5-LOW' order by o_totalprice desc nulls last, o_orderkey limit 500")
def q02(s, d):
    rows = table(s, d, "orders").where(C("o_orderstatus").isin("F", "O") & C("o_totalprice").between(1000, 400000) & ~(C("o_orderpriority") == "5-LOW"))
    return rows.orderBy(C("o_totalprice").desc_nulls_last(), "o_orderkey").limit(500).select("o_orderkey", "o_totalprice")


@query("Q03_event_rollup", "select user_id, count(*) as n, count(*) filter (event_type = 'purchase') as n_accounts, bool_or(event_type = 'error') as ever_dormant, min(ts) filter (event_type = 'error') as first_error, cast(sum(cast(json_extract_string(props, '$.k') as int)) as bigint) as k from events group by user_id")
def q03(s, d):
    e = table(s, d, "events").withColumn("props", F.from_json("props", "k int"))
    kind = C("event_type")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "purchase").alias("n_accounts"), F.bool_or(kind == "error").alias("ever_dormant"), F.min(F.when(kind == "error", C("ts"))).alias("first_error"), F.sum("props.k").alias("k"))


@query("Q04_partitioned_parquet", "select year(o_orderdate) as year, count(*) as n from orders group by all")
def q04(s, d):
    """Writes orders by year to the warehouse, which executors share, and counts what is read back."""
    path = f"{s.conf.get('spark.sql.warehouse.dir')}/quarrystone_orders_by_year/{s.sparkContext.applicationId}"  # a session's own
    orders = table(s, d, "orders").withColumn("year", F.year("o_orderdate"))
    orders.repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)
    return s.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query(
    "Q05_line_islands",
    """with g as (select *, case when role = lag(role) over (partition by conv_id order by turn, text) then 0 else 1 end as fresh from conversations),
 i as (select *, sum(fresh) over (partition by conv_id order by turn, text rows unbounded preceding) as line from g)
 select conv_id, cast(line as bigint) as line, min(turn) as first_turn, count(*) as n, bool_or(regexp_matches(regexp_replace(lower(text), '\\s+', '', 'g'), '(tion|ment)')) as hit from i group by conv_id, line""",
)
def q05(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rows = table(s, d, "conversations").withColumn("fresh", F.when(C("role") == F.lag("role").over(w), 0).otherwise(1))
    rows = rows.withColumn("line", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "line").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"), F.bool_or(F.regexp_replace(F.lower("text"), r"\s+", "").rlike("(tion|ment)")).alias("hit"))


GATES = [("1 all", "true"), ("2 priced", "o_totalprice > 1000"), ("3 open", "o_totalprice > 1000 and o_orderstatus <> 'F'")]


@query("Q06_flow", " union all ".join(f"select 'orders' as step, '{k}' as stage, count(*) as n from orders where {p}" for k, p in GATES))
def q06(s, d):
    """All gates in one scan, then long."""
    one = table(s, d, "orders").agg(*(F.count_if(F.expr(p)).alias(k) for k, p in GATES))
    return one.select(F.lit("orders").alias("step"), F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), C(f"`{k}`").alias("n")) for k, _ in GATES))).alias("x")).select("step", "x.*")


@query(
    "Q07_star",
    """with o as (select o_custkey, min(cast(o_orderdate as date)) as born, max(cast(o_orderdate as date)) as died, count(*) as n from orders group by all)
 select c_custkey, n_name, r_name, o_custkey is not null as matched, date_diff('day', born, died) as lifespan_days, round(date_diff('day', born, died) / 365.25, 6) as lifespan_years, coalesce(n, 0) as n
 from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join o on c_custkey = o_custkey""",
)
def q07(s, d):
    day = F.to_date("o_orderdate")
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.min(day).alias("born"), F.max(day).alias("died"), F.count("*").alias("n"))
    days = F.datediff("died", "born")
    rows = table(s, d, "customer").join(table(s, d, "nation"), C("c_nationkey") == C("n_nationkey"), "left").join(table(s, d, "region"), C("n_regionkey") == C("r_regionkey"), "left").join(o, C("c_custkey") == C("o_custkey"), "left")
    return rows.select("c_custkey", "n_name", "r_name", C("o_custkey").isNotNull().alias("matched"), days.alias("lifespan_days"), r6(days / F.lit(365.25)).alias("lifespan_years"), F.coalesce("n", F.lit(0)).alias("n"))


@query("Q08_buckets", f"select era, bucket, place, count(*) as n from (select {ERA_SQL} as era, case when o_totalprice < 100000 then 'a' when o_totalprice < 250000 then 'b' else 'c' end as bucket, case when o_orderstatus in ('F') then 'Central' else 'Outer' end as place from (select *, cast(o_orderdate as date) as born from orders)) group by all")
def q08(s, d):
    p = C("o_totalprice")
    rows = table(s, d, "orders").select(classify.era(F.to_date("o_orderdate")).alias("era"), F.when(p < 100000, "a").when(p < 250000, "b").otherwise("c").alias("bucket"), F.when(C("o_orderstatus").isin("F"), "Central").otherwise("Outer").alias("place"))
    return rows.groupBy("era", "bucket", "place").agg(F.count("*").alias("n"))


STATUS = {"1-urgent": "failing", "2-high": "closing", "3-medium": "alive"}


@query("Q09_status", "select o_orderkey, case when lower(trim(o_orderpriority)) in ('1-urgent', '2-high') then 'dead' when lower(trim(o_orderpriority)) like '%not%' then 'unknown' else 'alive' end as status, contains(o_orderpriority, '-') as dashed, coalesce(case lower(trim(o_orderpriority)) " + " ".join(f"when '{k}' then '{v}'" for k, v in STATUS.items()) + " end, 'unknown') as outcome from orders")
def q09(s, d):
    p = F.lower(F.trim("o_orderpriority"))
    lookup = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return table(s, d, "orders").select("o_orderkey", F.when(p.isin("1-urgent", "2-high"), "dead").when(p.like("%not%"), "unknown").otherwise("alive").alias("status"), C("o_orderpriority").contains("-").alias("dashed"), F.coalesce(F.try_element_at(lookup, p), F.lit("unknown")).alias("outcome"))


@query("Q10_preference", "select doc_id, coalesce(nullif(lang, 'en'), nullif(source, 'src0'), 'none') as best, case when n_chars > 1000 then n_chars end as equity, coalesce(case when n_chars > 1000 then n_chars end, case when lang <> 'en' then length(source) end) as best_equity from documents")
def q10(s, d):
    equity = F.when(C("n_chars") > 1000, C("n_chars"))
    return table(s, d, "documents").select("doc_id", F.coalesce(F.nullif("lang", F.lit("en")), F.nullif("source", F.lit("src0")), F.lit("none")).alias("best"), equity.alias("equity"), F.coalesce(equity, F.when(C("lang") != "en", F.length("source").cast("long"))).alias("best_equity"))


@query("Q10b_location_tiers", "with o as (select distinct o_custkey from orders where o_totalprice > 300000), h as (select s_nationkey from supplier group by 1 having count(*) >= 5) select c_custkey, case when o_custkey is not null then 'A' when h.s_nationkey is not null then 'B' else 'C' end as tier from customer left join o on c_custkey = o_custkey left join h on c_nationkey = h.s_nationkey")
def q10b(s, d):
    o = table(s, d, "orders").where("o_totalprice > 300000").select("o_custkey").distinct()
    h = table(s, d, "supplier").groupBy("s_nationkey").count().where("count >= 5").select("s_nationkey")
    rows = table(s, d, "customer").join(o, C("c_custkey") == C("o_custkey"), "left").join(h, C("c_nationkey") == C("s_nationkey"), "left")
    return rows.select("c_custkey", F.when(C("o_custkey").isNotNull(), "A").when(C("s_nationkey").isNotNull(), "B").otherwise("C").alias("tier"))


@query(
    "Q11_event_date_repair",
    """with f as (select user_id, min(cast(ts as date)) as failed from events where event_type = 'error' group by 1), l as (select user_id, min(cast(ts as date)) as born, max(cast(ts as date)) filter (event_type = 'signup') as died from events group by 1),
 x as (select *, coalesce(died, failed, date '2024-01-30') as event_date from l left join f using (user_id)) select user_id, born, event_date, case when event_date >= born then date_diff('day', born, event_date) end as lifespan_days from x""",
)
def q11(s, d):
    day, kind = F.to_date("ts"), C("event_type")
    rows = table(s, d, "events").groupBy("user_id").agg(F.min(day).alias("born"), F.max(F.when(kind == "signup", day)).alias("died"), F.min(F.when(kind == "error", day)).alias("failed"))
    rows = rows.withColumn("event_date", F.coalesce("died", "failed", F.to_date(F.lit("2024-01-30"))))
    return rows.select("user_id", "born", "event_date", F.when(C("event_date") >= C("born"), F.datediff("event_date", "born")).alias("lifespan_days"))


@query("Q12_select_where", "select l_orderkey, l_linenumber, l_quantity, case when l_discount > 0.05 then 'high' when l_discount > 0 then 'low' else 'none' end as band, round(case when l_tax > 0 then l_discount / l_tax end, 6) as ratio, least(greatest(l_extendedprice, 2000), 60000) as clipped from lineitem")
def q12(s, d):
    x = C("l_discount")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(x > 0.05, "high").when(x > 0, "low").otherwise("none").alias("band"), r6(F.when(C("l_tax") > 0, x / C("l_tax"))).alias("ratio"), F.least(F.greatest("l_extendedprice", F.lit(2000.0)), F.lit(60000.0)).alias("clipped"))


@query("Q13_parameters", "select o_orderkey, o_totalprice from orders where o_orderpriority in ('1-URGENT', '5-LOW') and o_totalprice > 200000")
def q13(s, d):
    return s.sql("select o_orderkey, o_totalprice from {orders} where array_contains(:kinds, o_orderpriority) and o_totalprice > :least", args={"kinds": F.array(F.lit("1-URGENT"), F.lit("5-LOW")), "least": 200000.0}, orders=table(s, d, "orders"))


@query("Q14_inner_star", "select n_name, count(*) as n, round(sum(l_extendedprice), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join supplier on l_suppkey = s_suppkey and s_acctbal > c_acctbal where l_shipdate > o_orderdate group by n_name")
def q14(s, d):
    rows = table(s, d, "lineitem").join(table(s, d, "orders"), (C("l_orderkey") == C("o_orderkey")) & (C("l_shipdate") > C("o_orderdate"))).join(table(s, d, "customer"), C("o_custkey") == C("c_custkey")).join(table(s, d, "nation"), C("c_nationkey") == C("n_nationkey"))
    rows = rows.join(table(s, d, "supplier"), (C("l_suppkey") == C("s_suppkey")) & (C("s_acctbal") > C("c_acctbal")))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


SUCCESSION_SQL = """pool as (select event_id, user_id, ts, event_type, value, 'own' as pool from events),
 dead as (select event_id, user_id, ts, event_type as died_as from events where event_type = 'error'),
 met as (select e.event_id, p.event_id as successor, p.ts as successor_ts, p.event_type as successor_type, row_number() over (partition by e.event_id order by p.ts, p.event_id) as rn
  from dead e join pool p on e.user_id = p.user_id and p.event_id <> e.event_id and p.event_type <> 'error' and p.ts >= e.ts - interval 1 hour and p.ts <= e.ts + interval 24 hour),
 succession as (select d.event_id, d.user_id, successor, successor_type, case successor_type when 'purchase' then 'food' when 'signup' then 'retail' when 'view' then 'other' when 'click' then 'other' end as industry,
  epoch(successor_ts - d.ts) as gap, 'error->' || coalesce(successor_type, 'dark') as transition, successor is null as went_dark, d.ts from dead d left join met m on d.event_id = m.event_id and rn = 1)"""


def succession(s, d):
    """Each error with the first other event of its user from an hour before to a day after."""
    e = table(s, d, "events")
    dead = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    pool = e.where("event_type <> 'error'").select("user_id", C("event_id").alias("successor"), C("ts").alias("successor_ts"), C("event_type").alias("successor_type"))
    hour = 3_600_000_000
    out = linkage.first_within(dead, pool, "user_id", "ts", "successor_ts", hour, 24 * hour, "event_id", "successor")
    industry = F.create_map(*(F.lit(x) for x in ("purchase", "food", "signup", "retail", "view", "other", "click", "other")))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.withColumns({
        "industry": F.try_element_at(industry, C("successor_type")), "gap": (micros("successor_ts") - micros("ts")) / F.lit(1e6),
        "transition": F.concat(F.lit("error->"), F.coalesce("successor_type", F.lit("dark"))), "went_dark": C("successor").isNull(),
    })


@query("Q15_interval_asof_successor", f"with {SUCCESSION_SQL} select event_id, user_id, successor, industry, round(gap, 3) as gap, transition, went_dark from succession")
def q15(s, d):
    return succession(s, d).select("event_id", "user_id", "successor", "industry", F.round("gap", 3).alias("gap"), "transition", "went_dark")


@query("Q16_anti_union", "select c_custkey as k, 'live' as src from customer where not exists (select 1 from orders where o_custkey = c_custkey) union all select distinct o_custkey, 'register' from orders")
def q16(s, d):
    orders = table(s, d, "orders")
    live = table(s, d, "customer").join(orders, C("c_custkey") == C("o_custkey"), "left_anti").select(C("c_custkey").alias("k"), F.lit("live").alias("src"))
    return live.unionByName(orders.select(C("o_custkey").alias("k"), F.lit("register").alias("src")).distinct())


@query("Q17_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.08) and o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def q17(s, d):
    o = table(s, d, "orders").join(table(s, d, "lineitem").where("l_discount > 0.08"), C("l_orderkey") == C("o_orderkey"), "left_semi")
    return o.join(table(s, d, "customer").where("c_acctbal > 0"), C("o_custkey") == C("c_custkey"), "left_semi").select("o_orderkey")


@query("Q18_mark_join", "select year(o_orderdate) as year, count(*) as n, cast(sum(case when not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then 1 else 0 end) as bigint) as pre_deadline from orders group by 1")
def q18(s, d):
    seen = table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("seen", F.lit(True))
    return table(s, d, "orders").join(seen, C("l_orderkey") == C("o_orderkey"), "left").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(C("seen").isNull()).alias("pre_deadline"))


@query("Q19_or_join", "select distinct p_partkey, s_suppkey from part join supplier on s_suppkey = p_size or s_suppkey = p_partkey % 97 or s_suppkey = p_partkey % 31")
def q19(s, d):
    parts = table(s, d, "part").select("p_partkey", C("p_size").cast("string").alias("a"), (C("p_partkey") % 97).cast("string").alias("b"), (C("p_partkey") % 31).cast("string").alias("c"))
    sup = table(s, d, "supplier").select("s_suppkey", C("s_suppkey").cast("string").alias("k"))
    return linkage.any_key_join(parts, sup, ["a", "b", "c"], "k").select("p_partkey", "s_suppkey")


@query("Q20_latest", "select o_custkey, o_orderkey, o_orderstatus, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def q20(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("Q22_explode", "select w, count(*) as n from (select unnest(string_split(p_name, ' ')) as w from part) group by w union all select a || n, 0 from (values ('N'), ('E'), ('SW')) t(a) cross join range(0, 31) r(n)")
def q22(s, d):
    words = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    grid = s.range(0, 31).select(F.explode(F.transform(F.array(*map(F.lit, ("N", "E", "SW"))), lambda a: F.concat(a, C("id").cast("string")))).alias("w"), F.lit(0).alias("n"))
    return words.unionByName(grid)


@query("Q23_distinct_counts", "select c_mktsegment, count(distinct o_custkey) as buyers, count(distinct o_orderpriority) as kinds, count(distinct case when o_orderstatus = 'F' then o_custkey end) as finished from customer left join orders on c_custkey = o_custkey group by 1")
def q23(s, d):
    rows = table(s, d, "customer").join(table(s, d, "orders"), C("c_custkey") == C("o_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.countDistinct("o_custkey").alias("buyers"), F.countDistinct("o_orderpriority").alias("kinds"), F.countDistinct(F.when(C("o_orderstatus") == "F", C("o_custkey"))).alias("finished"))


@query("Q24_conditional_shares", "select l_returnflag, cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as f, count(*) filter (l_discount > 0.05) as d, round(100.0 * sum(case when l_linestatus = 'F' then 1 else 0 end) / count(*), 4) as share from lineitem group by 1")
def q24(s, d):
    f = F.count_if(C("l_linestatus") == "F")
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(f.alias("f"), F.count_if(C("l_discount") > 0.05).alias("d"), F.round(F.lit(100.0) * f / F.count("*"), 4).alias("share"))


@query("Q25_entities_and_keys", "select l_suppkey as entity, min(l_shipdate) as first_seen, min(l_returnflag) as flag, count(distinct l_partkey) as keys from lineitem group by 1")
def q25(s, d):
    rows = table(s, d, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_returnflag")
    return rows.groupBy(C("l_suppkey").alias("entity")).agg(F.min("l_shipdate").alias("first_seen"), F.min("l_returnflag").alias("flag"), F.countDistinct("l_partkey").alias("keys"))


@query("Q26_two_level", "with a as (select o_custkey, list_sort(list(distinct o_orderpriority)) as kinds, max(case when o_orderstatus = 'F' then 1 else 0 end) as any_f from orders group by 1), x as (select o_custkey, any_f, unnest(kinds) as kind from a) select kind, count(*) as n, cast(sum(any_f) as bigint) as with_f from x group by 1")
def q26(s, d):
    a = table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"), F.max(F.when(C("o_orderstatus") == "F", 1).otherwise(0)).alias("any_f"))
    return a.select("any_f", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.sum("any_f").alias("with_f"))


@query("Q27_nonnull_share", "select lang, count(*) as n, count(toxic) as labelled, round(100.0 * count(toxic) / count(*), 2) as pct from documents left join labels using (doc_id) group by lang")
def q27(s, d):
    rows = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count("toxic").alias("labelled"), F.round(F.lit(100.0) * F.count("toxic") / F.count("*"), 2).alias("pct"))


@query("Q28_hubs", "with k as (select l_suppkey, l_partkey, count(*) as n from lineitem group by all), p as (select l_suppkey, count(*) as at_supplier from lineitem group by 1) select k.l_suppkey, l_partkey, n, at_supplier, n >= 10 as is_hub from k join p on k.l_suppkey = p.l_suppkey")
def q28(s, d):
    """The coarse count is summed from the fine one: the lines are scanned and shuffled once."""
    k = table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    p = k.groupBy("l_suppkey").agg(F.sum("n").alias("at_supplier"))
    return k.join(p, "l_suppkey").withColumn("is_hub", C("n") >= 10)


@query("Q29_group_ratios", "select c_mktsegment, round(100.0 * avg(case when c_acctbal < 3000 then 1.0 else 0.0 end), 4) as below_pct, median(c_acctbal) as median_bal, round(sum(c_acctbal) / nullif(sum(case when c_acctbal < 0 then c_acctbal end), 0), 6) as guarded from customer group by 1")
def q29(s, d):
    b = C("c_acctbal")
    rows = table(s, d, "customer")
    rest = rows.groupBy("c_mktsegment").agg(F.round(100.0 * F.avg((b < 3000).cast("double")), 4).alias("below_pct"), r6(F.try_divide(F.sum(b), F.sum(F.when(b < 0, b)))).alias("guarded"))
    return rest.join(stats.quantiles(rows, ["c_mktsegment"], "c_acctbal", {"median_bal": 0.5}).drop("n"), "c_mktsegment").select("c_mktsegment", "below_pct", "median_bal", "guarded")


RATES = [("1995-01-01", "1996-06-30", 0.175), ("1996-07-01", "1998-12-31", 0.05), ("1999-01-01", "2001-12-31", 0.125)]
STREAMS = [("hot", 0.6), ("cold", 0.4)]
SCENARIOS = [0.7, 0.8, 0.9]


@query(
    "Q30_overlap_rates",
    "with r(a, b, rate) as (values " + ", ".join(f"(date '{a}', date '{b}', {x}::double)" for a, b, x in RATES) + "), t(stream, share) as (values " + ", ".join(f"('{n}', {x}::double)" for n, x in STREAMS) + "), sc(kept) as (values " + ", ".join(f"({x}::double)" for x in SCENARIOS) + """),
 y as (select year(o_orderdate) as y, sum(o_totalprice) as revenue from orders group by 1), w as (select y, revenue, make_date(y, 1, 1) as a0, make_date(y, 12, 31) as b0 from y),
 z as (select y, revenue, sum(rate * greatest(0, date_diff('day', greatest(a, a0), least(b, b0)) + 1)) / max(date_diff('day', a0, b0) + 1) as rate from w cross join r group by all)
 select cast(y as int) as year, stream, kept, round(revenue * share * kept * rate / (1 + rate), 2) as tax from z cross join t cross join sc""",
)
def q30(s, d):
    year = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue"))
    a0, b0 = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    overlap = sum((x * F.greatest(F.lit(0), F.datediff(F.least(F.to_date(F.lit(b)), b0), F.greatest(F.to_date(F.lit(a)), a0)) + 1) for a, b, x in RATES), F.lit(0.0))
    year = year.withColumn("rate", overlap / (F.datediff(b0, a0) + 1))
    dims = F.array(*(F.struct(F.lit(n).alias("stream"), F.lit(x).alias("share"), F.lit(k).alias("kept")) for n, x in STREAMS for k in SCENARIOS))
    return year.withColumn("x", F.explode(dims)).select("year", "x.stream", "x.kept", F.round(C("revenue") * C("x.share") * C("x.kept") * C("rate") / (1 + C("rate")), 2).alias("tax"))


@query(
    "Q31_growth",
    """with y as (select o_custkey, year(o_orderdate) as y, sum(o_totalprice) as v from orders group by all), l as (select *, lag(v) over w as pv, lag(y) over w as py from y window w as (partition by o_custkey order by y)),
 g as (select y, v / pv - 1 as g from l where py = y - 1 and pv > 1000), b as (select quantile_cont(g, 0.01) as lo, quantile_cont(g, 0.99) as hi from g), c as (select y, least(greatest(g, lo), hi) as g from g cross join b)
 select cast(y as int) as year, count(*) as n, round(median(g), 6) as median, round(quantile_cont(g, 0.25), 6) as q1, round(quantile_cont(g, 0.75), 6) as q3, round(avg(case when g > 0 then 1.0 else 0.0 end), 6) as positive from c group by 1""",
)
def q31(s, d):
    g = growth(s, d)
    rest = g.groupBy("year").agg(F.count("*").alias("n"), r6(F.avg((C("g") > 0).cast("double"))).alias("positive"))
    return rest.join(stats.quantiles(g, ["year"], "g", {"median": 0.5, "q1": 0.25, "q3": 0.75}).drop("n"), "year").select("year", "n", *(r6(c).alias(c) for c in ("median", "q1", "q3")), "positive")


def growth(s, d):
    y = table(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("o_custkey").orderBy("year")
    y = y.withColumns({"pv": F.lag("v").over(w), "py": F.lag("year").over(w)}).where((C("py") == C("year") - 1) & (C("pv") > 1000))
    return stats.winsorised(y.select("o_custkey", "year", (C("v") / C("pv") - 1).alias("g")), "g")


@query(
    "Q31b_mann_whitney",
    """with x as (select l_extendedprice as v, l_linestatus = 'F' as a from lineitem), r as (select v, count(*) as ties, count(*) filter (a) as ones from x group by 1), m as (select *, coalesce(sum(ties) over (order by v rows between unbounded preceding and 1 preceding), 0) + (ties + 1) / 2 as mid from r),
 z as (select sum(ones) as n1, sum(ties) - sum(ones) as n2, sum(ones * mid) as r1 from m) select cast(n1 as double) as n1, cast(n2 as double) as n2, r1 - n1 * (n1 + 1) / 2 as u, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 6) as effect, (select median(v) from x where a) as median_1, (select median(v) from x where not a) as median_2 from z""",
)
def q31b(s, d):
    return stats.mann_whitney(table(s, d, "lineitem"), "l_extendedprice", C("l_linestatus") == "F").select("n1", "n2", "u", r6("effect").alias("effect"), "median_1", "median_2")


YEARS_SQL = "case era " + " ".join(f"when '{k}' then {v!r}::double" for k, v in classify.ERA_YEARS.items()) + " end"


@query("Q32_rate_per_year", f"with {LIFE_SQL} select era, format, count(*) as n, round(count(*) / {YEARS_SQL}, 4) as per_year from life where era is not null group by era, format")
def q32(s, d):
    years = F.create_map(*(F.lit(x) for kv in classify.ERA_YEARS.items() for x in kv))
    return life(s, d).where("era is not null").groupBy("era", "format").agg(F.count("*").alias("n")).withColumn("per_year", F.round(C("n") / years[C("era")], 4))


@query("Q32b_index", "with p as (select year(o_orderdate) as y, quarter(o_orderdate) as q, sum(o_totalprice) / count(distinct cast(o_orderdate as date)) as v from orders group by all), b as (select avg(v) as base from p where y = 1996) select cast(y as int) as year, cast(q as int) as quarter, round(100 * v / base, 4) as idx from p cross join b")
def q32b(s, d):
    p = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg((F.sum("o_totalprice") / F.countDistinct(F.to_date("o_orderdate"))).alias("v"))
    base = p.where("year = 1996").agg(F.avg("v").alias("base"))  # one row
    return p.crossJoin(F.broadcast(base)).select("year", "quarter", F.round(100 * C("v") / C("base"), 4).alias("idx"))


@query("Q32c_growth_table", "select c_nationkey, count(*) filter (year(o_orderdate) between 1995 and 1997) as early, count(*) filter (year(o_orderdate) between 1998 and 2000) as late, round(100.0 * (count(*) filter (year(o_orderdate) between 1998 and 2000)) / (count(*) filter (year(o_orderdate) between 1995 and 1997)) - 100, 4) as growth from orders join customer on o_custkey = c_custkey group by 1 having count(*) filter (year(o_orderdate) between 1995 and 1997) >= 50")
def q32c(s, d):
    y = F.year("o_orderdate")
    rows = table(s, d, "orders").join(table(s, d, "customer"), C("o_custkey") == C("c_custkey")).groupBy("c_nationkey").agg(F.count_if(y.between(1995, 1997)).alias("early"), F.count_if(y.between(1998, 2000)).alias("late"))
    return rows.where("early >= 50").withColumn("growth", F.round(F.lit(100.0) * C("late") / C("early") - 100, 4))


@query(
    "Q33_entry_mix_wilson",
    f"""with {LIFE_SQL}, p as (select year(born) as year, count(*) filter (format = 'counter') as counter, count(*) filter (format = 'service') as service from life group by 1), x as (select *, counter + service as n, counter / (counter + service) as p from p)
 select cast(year as int) as year, counter, service, round(p, 6) as share, round(((p + 1.96 * 1.96 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
 round(((p + 1.96 * 1.96 / (2 * n)) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from x""",
)
def q33(s, d):
    p = life(s, d).groupBy(F.year("born").alias("year")).pivot("format", ["counter", "service"]).agg(F.count(F.lit(1))).fillna(0, ["counter", "service"])
    n = C("counter") + C("service")
    low, high = stats.wilson(C("counter"), n)
    return p.select("year", "counter", "service", r6(C("counter") / n).alias("share"), r6(low).alias("low"), r6(high).alias("high"))


@query(
    "Q33b_two_proportions",
    f"""with {LIFE_SQL}, c as (select count(*) filter (era = 'early' and format = 'counter') as k1, count(*) filter (era = 'early') as n1, count(*) filter (era = 'late' and format = 'counter') as k2, count(*) filter (era = 'late') as n2 from life),
 x as (select *, k1 / n1 as p1, k2 / n2 as p2, (k1 + k2) / (n1 + n2) as p from c), y as (select *, sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) as se from x)
 select round(p1 - p2, 6) as difference, round(p1 - p2 - 1.96 * se, 6) as low, round(p1 - p2 + 1.96 * se, 6) as high, round((p1 - p2) / sqrt(p * (1 - p) * (1.0 / n1 + 1.0 / n2)), 4) as z from y""",
)
def q33b(s, d):
    era, counter = C("era"), C("format") == "counter"
    c = life(s, d).agg(F.count_if((era == "early") & counter).alias("k1"), F.count_if(era == "early").alias("n1"), F.count_if((era == "late") & counter).alias("k2"), F.count_if(era == "late").alias("n2"))
    out = stats.two_proportions(C("k1"), C("n1"), C("k2"), C("n2"))
    return c.select(*(F.round(out[k], 4 if k == "z" else 6).alias(k) for k in ("difference", "low", "high", "z")))  # p has no SQL: the tests hold it


@query("Q33c_pivot_ratio", "with p as (select c_mktsegment as seg, c_nationkey, sum(o_totalprice) filter (year(o_orderdate) = 1996) as a, sum(o_totalprice) filter (year(o_orderdate) = 2000) as b from orders join customer on o_custkey = c_custkey group by all) select seg, count(*) as n, round(avg(b / a), 6) as mean_ratio, round(sum(b) / sum(a), 6) as ratio from p where a > 0 and b > 0 group by 1")
def q33c(s, d):
    rows = table(s, d, "orders").join(table(s, d, "customer"), C("o_custkey") == C("c_custkey"))
    p = rows.groupBy(C("c_mktsegment").alias("seg"), "c_nationkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v")).groupBy("seg", "c_nationkey").pivot("y", [1996, 2000]).agg(F.sum("v"))
    a, b = C("1996"), C("2000")
    return p.where((a > 0) & (b > 0)).groupBy("seg").agg(F.count("*").alias("n"), r6(F.avg(b / a)).alias("mean_ratio"), r6(F.sum(b) / F.sum(a)).alias("ratio"))


@query(
    "Q34_quarter_grid",
    f"""with {LIFE_SQL}, q as (select cast(unnest(generate_series(date '1995-01-01', date '2001-10-01', interval 3 month)) as date) as q0)
 select q0 as quarter, format, count(*) filter (died >= q0 and died < q0 + interval 3 month) as deaths, count(*) filter (born < q0 and died >= q0) as at_risk,
 round(1000.0 * (count(*) filter (died >= q0 and died < q0 + interval 3 month)) / greatest(count(*) filter (born < q0 and died >= q0), 1), 4) as per_1000 from q cross join life group by all""",
)
def q34(s, d):
    """Entities enter the count at the first quarter after birth and leave it after the quarter of death: sums of changes over the grid
    of quarters, where the calendar join would be a product."""
    quarter = lambda c: F.trunc(c, "quarter")
    rows = life(s, d)
    moves = rows.select("format", F.explode(F.array(F.struct(F.add_months(quarter("born"), 3).alias("q"), F.lit(1).alias("x"), F.lit(0).alias("dead")), F.struct(quarter("died").alias("q"), F.lit(0).alias("x"), F.lit(1).alias("dead")), F.struct(F.add_months(quarter("died"), 3).alias("q"), F.lit(-1).alias("x"), F.lit(0).alias("dead")))).alias("m")).select("format", "m.*")
    moves = moves.groupBy("format", C("q").alias("quarter")).agg(F.sum("x").alias("x"), F.sum("dead").alias("deaths"))
    grid = s.range(1).select(F.explode(F.sequence(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2001-10-01")), F.expr("interval 3 month"))).alias("quarter")).crossJoin(rows.select("format").distinct())  # quarters by formats
    full = grid.join(moves, ["format", "quarter"], "full")
    w = Window.partitionBy("format").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("at_risk", F.sum(F.coalesce("x", F.lit(0))).over(w)).withColumn("deaths", F.coalesce("deaths", F.lit(0)))
    full = full.where(C("quarter").between(F.to_date(F.lit("1995-01-01")), F.to_date(F.lit("2001-10-01"))))
    return full.select("quarter", "format", "deaths", "at_risk", F.round(F.lit(1000.0) * C("deaths") / F.greatest("at_risk", F.lit(1)), 4).alias("per_1000"))


@query("Q35_concentration", "with c as (select l_suppkey, count(*) as n from lineitem group by 1), w as (select *, sum(n) over (order by n desc, l_suppkey rows unbounded preceding) as cum, row_number() over (order by n desc, l_suppkey) as k, sum(n) over () as total from c) select min(k) as keys, cast(min(total) as bigint) as total from w where cum >= total / 2")
def q35(s, d):
    c = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    # keys of one size are alike: the window runs over distinct sizes, and the last size is entered only as far as needed
    sizes = c.groupBy("n").agg(F.count("*").alias("keys"), (F.count("*") * C("n")).alias("rows"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("rows").alias("total")))).withColumns({"before": F.coalesce(F.sum("rows").over(w), F.lit(0)), "keys_before": F.coalesce(F.sum("keys").over(w), F.lit(0))})
    hit = sizes.where((C("before") * 2 < C("total")) & ((C("before") + C("rows")) * 2 >= C("total")))
    return hit.select((C("keys_before") + F.ceil((C("total") / 2 - C("before")) / C("n"))).alias("keys"), "total")


@query("Q36_top_k_per_group", "select p_brand, p_type, n from (select *, row_number() over (partition by p_brand order by n desc, p_type) as rn from (select p_brand, p_type, count(*) as n from part group by all)) where rn <= 3")
def q36(s, d):
    c = table(s, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("rn <= 3").drop("rn")


@query("Q37_md5_sample", "select c_custkey, c_name from customer order by md5(cast(c_custkey as varchar)), c_custkey limit 50")
def q37(s, d):
    return table(s, d, "customer").orderBy(F.md5(C("c_custkey").cast("string").cast("binary")), "c_custkey").limit(50).select("c_custkey", "c_name")


QUOTA = {"BUILDING": 10, "MACHINERY": 20, "HOUSEHOLD": 5}


@query("Q38_stratified_sample", "select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by md5(cast(c_custkey as varchar)), c_custkey) as rn from customer) where rn <= case c_mktsegment " + " ".join(f"when '{k}' then {v}" for k, v in QUOTA.items()) + " else 0 end")
def q38(s, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.md5(C("c_custkey").cast("string").cast("binary")), "c_custkey")
    quota = F.create_map(*(F.lit(x) for kv in QUOTA.items() for x in kv))
    rows = table(s, d, "customer").where(C("c_mktsegment").isin(*QUOTA)).withColumn("rn", F.row_number().over(w))
    return rows.where((C("rn") <= max(QUOTA.values())) & (C("rn") <= quota[C("c_mktsegment")])).select("c_custkey", "c_mktsegment")


@query("Q39_union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier union select n_nationkey from nation")
def q39(s, d):
    return linkage.union_all([table(s, d, t).select(C(c).alias("k")) for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]).distinct()


@query("Q81_windowed_counts", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by all")
def q81(s, d):
    """The streaming extension's aggregate, on the table."""
    from quarrystone.streaming.ingest import windowed_counts

    return windowed_counts(table(s, d, "events"), "ts", "event_type").withColumn("start", C("start").cast("timestamp_ntz"))


@query("Q82_rollup_and_sets", "select c_mktsegment, c_nationkey, count(*) as n from customer where c_nationkey in (select c_nationkey from customer intersect select s_nationkey from supplier) group by rollup (c_mktsegment, c_nationkey)")
def q82(s, d):
    both = table(s, d, "customer").select("c_nationkey").intersect(table(s, d, "supplier").select(C("s_nationkey").alias("c_nationkey")))
    return table(s, d, "customer").join(both, "c_nationkey", "left_semi").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
