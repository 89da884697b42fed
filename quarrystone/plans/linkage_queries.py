"""Keys, names, markup, timelines and classifiers on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrystone.functions import candidates, classify, normalise
from quarrystone.operators import linkage, logit, prediction
from quarrystone.plans.base import query, r6
from quarrystone.session import table
from quarrystone.sources.markup import facts

C = F.col


@query("Q05b_markup_facts")
def q05b(s, d):
    """Facts of each page, the latest strong one by name, from a streaming parser."""
    return facts(table(s, d, "pages"), "page_id", "html")


#: The rules of a parser in two expressions: what stands in scripts, styles and comments is no markup, and the title's entities that occur are put back.
@query(
    "Q05c_titles_links",
    r"""with p as (select page_id, regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') as h from pages)
 select page_id, trim(replace(replace(replace(replace(regexp_extract(h, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) as title, len(regexp_extract_all(h, '(?i)<a\s+href="[^"]')) as links, 0 as facts_seen from p""",
)
def q05c(s, d):
    return facts(table(s, d, "pages"), "page_id", "html").select("page_id", "title", "links", "facts_seen")


#: Words that the documents have in place of top lines and taxes.
WORDS, TERMS = r"\b(?:token|licen[cs]e[sd]?)\b", ["licen[cs]e", r"\btoken\b", r"\d{13,16}"]
FLAT_SQL = r"docs as (select doc_id, regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g') as flat from documents)"


@query(
    "Q84_figure_lines",
    rf"""with {FLAT_SQL}, l as (select doc_id, list_filter(list_transform(regexp_split_to_array(flat, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(x)), lambda x: x <> '') as lines from docs),
 n as (select doc_id, lines, unnest(range(1, len(lines) + 1)) as n from l), h as (select *, row_number() over (partition by doc_id order by n) as k from n where regexp_matches(lines[n], '(?i){WORDS}') and regexp_matches(lines[n], '-?[\d,]{{3,}}(?:\.\d)?'))
 select doc_id, cast(n as int) as n, substr(lines[n], 1, 200) as line, case when n > 1 then substr(lines[n - 1], 1, 200) end as before, substr(lines[n + 1], 1, 200) as after from h where k <= 40""",
)
def q84(s, d):
    return candidates.figure_lines(table(s, d, "documents"), "doc_id", "text", WORDS)


@query(
    "Q84b_snippets",
    rf"""with {FLAT_SQL}, t as (select unnest(range(1, {len(TERMS) + 1})) as o, unnest(['{"', '".join(TERMS)}']) as term),
 f as (select doc_id, flat, o, term, regexp_split_to_array(flat, '(?i)' || term) as parts, regexp_extract_all(flat, '(?i)' || term) as found from docs cross join t),
 m as (select doc_id, flat, o, term, parts, found, unnest(range(1, len(found) + 1)) as i from f),
 a as (select *, coalesce(list_sum(list_transform(parts[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda x: length(x))), 0) as place from m),
 r as (select *, row_number() over (partition by doc_id order by o, i) as n from a)
 select doc_id, cast(n as int) as n, term, cast(place as int) as place, trim(regexp_replace(substr(flat, cast(greatest(0, place - 110) as bigint) + 1, cast(place + 220 - greatest(0, place - 110) as bigint)), '\s+', ' ', 'g')) as snippet from r where n <= 40""",
)
def q84b(s, d):
    return candidates.snippets(table(s, d, "documents"), "doc_id", "text", TERMS)


PC_SQL = "regexp_replace(upper('n' || (page_id % 20) || ' ' || (page_id % 10) || 'ab'), '[^A-Z0-9]', '', 'g')"
PLAIN_SQL = "trim(regexp_replace(regexp_replace(upper({x}), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "Q50_address_keys",
    f"""with a as (select page_id, {PC_SQL} as pc, case page_id % 5 when 3 then 'C/O Smith & Co, ' when 4 then '' else 'Unit ' || (page_id % 7) || ', ' end || (page_id % 90) || case page_id % 5 when 4 then ' c/o Park and Sons' else '' end || ' High Road' || case page_id % 3 when 0 then ' London' when 1 then ' London Greater London' else '' end as line, url from pages),
 h as (select *, case when regexp_matches(line, '(?i)^C/O\\s') then regexp_extract(line, '[,\\s](\\d+[A-Z]?\\s+\\w.*)$', 1) when regexp_matches(line, '(?i)^\\S+\\s+C/O\\s') then split_part(line, ' ', 1) || ' ' || regexp_extract(line, '.*\\s(\\S+\\s+(?:ROAD|Road))', 1) else line end as own from a),
 b as (select *, {PLAIN_SQL.format(x="regexp_replace(upper(own), '^\\s*UNIT\\s*[-:,]?\\s*\\w{0,4}\\s*[-:,]?\\s*', '')")} as street from h),
 c as (select *, trim(regexp_replace(street, '(\\s+({'|'.join(normalise.TOWNS)}))+$', '')) as st from b)
 select page_id, case when length(pc) between 5 and 7 then substr(pc, 1, length(pc) - 3) || ' ' || substr(pc, length(pc) - 2, 3) else '' end as postcode, regexp_extract(pc, '^([A-Z]{{1,2}})', 1) as area, case when st = '' then '' else st || '|' || pc end as key, {PLAIN_SQL.format(x='url')} as url_key from c""",
)
def q50(s, d):
    i = C("page_id")
    text = lambda x: x.cast("string")
    pc = F.concat(F.lit("n"), text(i % 20), F.lit(" "), text(i % 10), F.lit("ab"))
    unit = F.when(i % 5 == 3, "C/O Smith & Co, ").when(i % 5 == 4, "").otherwise(F.concat(F.lit("Unit "), text(i % 7), F.lit(", ")))
    agent = F.when(i % 5 == 4, " c/o Park and Sons").otherwise("")
    line = F.concat(unit, text(i % 90), agent, F.lit(" High Road"), F.when(i % 3 == 0, " London").when(i % 3 == 1, " London Greater London").otherwise(""))
    return table(s, d, "pages").select("page_id", normalise.postcode(pc).alias("postcode"), normalise.postcode_area(pc).alias("area"), normalise.address_key(line, F.lit(""), pc).alias("key"), normalise.plain(C("url")).alias("url_key"))


@query(
    "Q51_names",
    f"""with n as (select c_custkey, 'The ' || c_mktsegment || ' & Sons (' || c_nationkey || ') Ltd' as name from customer)
 select c_custkey, trim(regexp_replace({PLAIN_SQL.format(x="replace(upper(name), '&', ' AND ')")}, '\\s+(LIMITED|LTD|PLC|LLP)$', '')) as strict,
 trim(regexp_replace(regexp_replace({PLAIN_SQL.format(x="replace(upper(name), '&', ' ')")}, '\\b(THE|LTD|LIMITED)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as loose from n""",
)
def q51(s, d):
    name = F.concat(F.lit("The "), C("c_mktsegment"), F.lit(" & Sons ("), C("c_nationkey").cast("string"), F.lit(") Ltd"))
    return table(s, d, "customer").select("c_custkey", normalise.company_name(name).alias("strict"), normalise.company_name_loose(name).alias("loose"))


@query(
    "Q52_name_tiers",
    """with q as (select distinct case p_partkey % 4 when 0 then upper(p_name) when 1 then p_name || ' (UK) Ltd' when 2 then p_name || 's' else string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] end as query from part),
 r as (select p_partkey, p_name from part),
 qn as (select query, trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(query), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+(LIMITED|LTD|PLC|LLP)$', '')) as n, trim(regexp_replace(trim(regexp_replace(regexp_replace(upper(regexp_replace(query, '\\([^)]*\\)', ' ', 'g')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\s+(LIMITED|LTD|PLC|LLP)$', '')) as b from q),
 m as (select query, p_partkey, p_name, case when n = upper(p_name) then 1 when b = upper(p_name) then 2 when levenshtein(n, upper(p_name)) <= case when length(n) > 12 then 2 else 1 end then 3
  when list_sort(string_split(n, ' ')) = list_sort(string_split(upper(p_name), ' ')) then 4 end as tier from qn cross join r),
 w as (select *, count(*) over (partition by query, tier) as candidates, row_number() over (partition by query order by tier, p_partkey) as rn from m where tier is not null)
 select query, p_partkey, p_name, tier, candidates from w where rn = 1""",
)
def q52(s, d):
    k, words = C("p_partkey") % 4, F.split("p_name", " ")
    q = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit(" (UK) Ltd"))).when(k == 2, F.concat("p_name", F.lit("s"))).otherwise(F.concat_ws(" ", words[1], words[0]))
    queries = table(s, d, "part").select(q.alias("query")).distinct()
    register = table(s, d, "part").select("p_partkey", "p_name")
    return linkage.name_tiers(queries, register, "query", "p_name", [C("p_partkey")]).select("query", "p_partkey", "p_name", "tier", "candidates")


@query("Q53_last_match", "select page_id, nullif(list_last(regexp_extract_all(url, '[a-z]+')), '') as last_word, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') as lang, nullif(regexp_extract(url, '/([0-9]+)', 1), '') as number from pages")
def q53(s, d):
    found = F.regexp_extract_all("url", F.lit("[a-z]+"), F.lit(0))
    return table(s, d, "pages").select("page_id", F.try_element_at(found, F.lit(-1)).alias("last_word"), F.nullif(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("")).alias("lang"), F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).alias("number"))


MOVES_SQL = "m as (select *, min(ts) filter (event_type = 'error') over (partition by user_id) as failed from events)"


@query(
    "Q53b_timeline",
    f"with {MOVES_SQL} select user_id, count(*) filter (event_type = 'click') as n_moves, arg_min(event_id, ts) filter (event_type = 'click') as first_place, arg_max(event_id, ts) filter (event_type = 'click' and ts < failed) as before_exit, arg_max(event_id, ts) filter (event_type = 'click') as current_place, coalesce(bool_or(event_type = 'click' and ts > failed), false) as moved_after from m group by user_id",
)
def q53b(s, d):
    m = with_first_failure(s, d)
    move, ts = C("event_type") == "click", C("ts")
    at = lambda p: F.when(p, ts)
    return m.groupBy("user_id").agg(F.count_if(move).alias("n_moves"), F.min_by("event_id", at(move)).alias("first_place"), F.max_by("event_id", at(move & (ts < C("failed")))).alias("before_exit"), F.max_by("event_id", at(move)).alias("current_place"), F.coalesce(F.bool_or(move & (ts > C("failed"))), F.lit(False)).alias("moved_after"))


def with_first_failure(s, d):
    e = table(s, d, "events")
    failed = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("failed"))
    return e.join(failed, "user_id", "left")


@query("Q53c_move_segments", f"with {MOVES_SQL}, c as (select user_id, count(*) filter (event_type = 'click' and ts < failed) as b, count(*) filter (event_type = 'click' and ts > failed) as a from m group by 1) select case when b > 0 and a > 0 then 'both' when b > 0 then 'before' when a > 0 then 'after' else 'none' end as segment, count(*) as n from c group by 1")
def q53c(s, d):
    move, ts = C("event_type") == "click", C("ts")
    c = with_first_failure(s, d).groupBy("user_id").agg(F.count_if(move & (ts < C("failed"))).alias("b"), F.count_if(move & (ts > C("failed"))).alias("a"))
    return c.groupBy(F.when((C("b") > 0) & (C("a") > 0), "both").when(C("b") > 0, "before").when(C("a") > 0, "after").otherwise("none").alias("segment")).agg(F.count("*").alias("n"))


@query(
    "Q54_overlap_verdict",
    """with p as (select p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x not in ('the', 'small', ''))) as a, list_distinct(list_filter(string_split(lower(p_type || ' ' || split_part(p_name, ' ', 2)), ' '), lambda x: x not in ('the', 'small', ''))) as b from part),
 s as (select p_partkey, case when least(len(a), len(b)) > 0 then len(list_intersect(a, b)) / least(len(a), len(b)) else 0.0 end as ov from p)
 select p_partkey, round(ov, 6) as overlap, 2 * cast(p_partkey % 2 = 0 as int) + cast(p_partkey % 3 = 0 as int) + case when ov >= 0.5 then 2 when ov > 0 then 1 else 0 end as score,
 case when 2 * cast(p_partkey % 2 = 0 as int) + cast(p_partkey % 3 = 0 as int) + case when ov >= 0.5 then 2 when ov > 0 then 1 else 0 end >= 4 then 'STRONG' when 2 * cast(p_partkey % 2 = 0 as int) + cast(p_partkey % 3 = 0 as int) + case when ov >= 0.5 then 2 when ov > 0 then 1 else 0 end >= 2 then 'PLAUSIBLE' else 'REVIEW' end as verdict from s""",
)
def q54(s, d):
    ov = linkage.overlap_score(C("p_name"), F.concat_ws(" ", "p_type", F.split("p_name", " ")[1]), ["the", "small"])
    k = C("p_partkey")
    score = 2 * (k % 2 == 0).cast("int") + (k % 3 == 0).cast("int") + F.when(C("ov") >= 0.5, 2).when(C("ov") > 0, 1).otherwise(0)
    rows = table(s, d, "part").select("p_partkey", ov.alias("ov")).withColumn("score", score)
    return rows.select("p_partkey", r6("ov").alias("overlap"), "score", F.when(C("score") >= 4, "STRONG").when(C("score") >= 2, "PLAUSIBLE").otherwise("REVIEW").alias("verdict"))


ROUTES = [("court", ["error"]), ("voluntary", ["signup"]), ("registrar", ["purchase"])]


@query("Q55_priority_route", "select user_id, case " + " ".join(f"when bool_or(event_type in ({', '.join(map(repr, k))})) then '{n}'" for n, k in ROUTES) + " else 'unknown' end as route, count(*) as n_events from events group by 1")
def q55(s, d):
    return classify.priority_route(table(s, d, "events"), "user_id", "event_type", ROUTES)


#: Stand-in forms of the events; a day of a user is an entity.
FORMS = {"error": "AM01", "signup": "LIQ01", "purchase": "LIQ02", "click": "DS01", "view": "GAZ1"}


@query(
    "Q55c_exit_route",
    "with f as (select user_id, cast(ts as date) as day, case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in FORMS.items()) + " end as form, case when value > 90 then 'Insolvency' end as category from events), "
    "h as (select user_id, day, coalesce(bool_or(form = 'AM01'), false) as am, coalesce(bool_or(form = 'LIQ01'), false) as de, coalesce(bool_or(form = 'LIQ02'), false) as cr, coalesce(bool_or(category = 'Insolvency'), false) as i, coalesce(bool_or(form = 'DS01'), false) as ds, coalesce(bool_or(form = 'GAZ1'), false) as ga from f group by 1, 2) "
    "select user_id || ' ' || strftime(day, '%Y-%m-%d') as entity, case when am then 'administration' when de and not cr then 'members_voluntary_liquidation' when cr then 'creditors_voluntary_liquidation' when i then 'insolvency_other' when ds then 'voluntary_strike_off' when ga then 'registrar_strike_off' else 'unknown' end as route, "
    "case when am then 'insolvency' when de and not cr then 'solvent_winding_up' when cr or i then 'insolvency' when ds then 'voluntary_dissolution' when ga then 'registrar_dissolution' else 'unknown' end as family from h",
)
def q55c(s, d):
    form = F.lit(None).cast("string")
    for kind, code in FORMS.items():
        form = F.when(C("event_type") == kind, code).otherwise(form)
    e = table(s, d, "events").select(F.concat_ws(" ", C("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("entity"), form.alias("form"), F.when(C("value") > 90, "Insolvency").alias("category"))
    return classify.exit_route(e, "entity", "form", "category")


@query(
    "Q56_last_event_route",
    """with a as (select user_id, max(ts) filter (event_type = 'error') as er, max(ts) filter (event_type = 'signup') as su, max(ts) filter (event_type = 'click') as cl from events group by 1), b as (select user_id, case when cl > su then null else su end as su, er from a),
 g as (select user_id, array_to_string((list(event_type || '@' || strftime(ts, '%Y-%m-%d') order by ts, event_id) filter (event_type in ('error', 'signup')))[1:12], ' || ') as digest from events group by 1)
 select user_id, case when er = greatest(er, su) then 'court' when su = greatest(er, su) then 'voluntary' else 'unknown' end as route, coalesce(digest, '') as digest from b join g using (user_id)""",
)
def q56(s, d):
    e = table(s, d, "events")
    route = classify.last_event_route(e, "user_id", "event_type", "ts", {"error": "court", "signup": "voluntary"}, {"signup": "click"})
    kept = C("event_type").isin("error", "signup")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = e.where(kept).withColumn("rn", F.row_number().over(w)).where("rn <= 12")  # twelve rows a user, whatever its history
    parts = F.array_sort(F.collect_list(F.struct("rn", F.concat("event_type", F.lit("@"), F.date_format("ts", "yyyy-MM-dd")).alias("t"))))
    digest = first.groupBy("user_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " || ").alias("digest"))
    return route.join(digest, "user_id", "left").select("user_id", "route", F.coalesce("digest", F.lit("")).alias("digest"))


@query(
    "Q57_auc_deciles",
    """with x as (select n_chars as score, toxic as y from documents join labels using (doc_id)), r as (select score, count(*) as ties, sum(y) as ones from x group by 1), m as (select *, coalesce(sum(ties) over (order by score rows between unbounded preceding and 1 preceding), 0) + (ties + 1) / 2 as mid from r),
 a as (select sum(ones) as n1, sum(ties) - sum(ones) as n0, sum(ones * mid) as r from m), b as (select unnest(range(1, 10)) as k), e as (select k, (select quantile_cont(score, k / 10) from x) as edge from b),
 t as (select 'auc' as part, 0 as decile, cast(n1 + n0 as bigint) as n, round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6) as value from a)
 select * from t union all select 'decile', cast(dec as int), count(*), round(avg(y), 6) from (select y, 1 + (select count(distinct edge) from e where edge < score) as dec from x) group by dec""".replace("(select quantile_cont(score, k / 10) from x)", "list_extract((select quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) from x), k)"),
)
def q57(s, d):
    x = table(s, d, "documents").select("doc_id", C("n_chars").alias("score")).join(table(s, d, "labels").select("doc_id", C("toxic").alias("y")), "doc_id")
    return prediction.deciles(x, "score", "y").withColumn("value", r6("value"))


@query("Q57r_ridge_logit")
def q57r(s, d):
    """Ridge logit of the label on two features: a step is one aggregate, the result is three terms."""
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("toxic", F.log1p("n_chars").alias("size"), (C("lang") == "en").cast("double").alias("english"))
    return logit.irls(x, ["size", "english"], "toxic")


#: Stand-ins for accounts: what a customer was shipped on a day.
ACCOUNTS_SQL = """accounts as (select o_custkey, cast(l_shipdate as date) as made_up, sum(l_extendedprice) - 40000 as equity, sum(l_extendedprice * l_discount) as cash, sum(l_extendedprice * 0.05) as current,
  sum(l_extendedprice * l_tax) as creditors, sum(l_quantity) as staff from lineitem join orders on l_orderkey = o_orderkey group by all),
 lives as (select o_orderkey, o_custkey, cast(o_orderdate as date) as born, lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) as died from orders),
 seen as (select *, date_diff('day', born, coalesce(died, date '2001-08-01')) as days, died is not null as event from lives),
 met as (select s.*, a.made_up, equity, cash, current, creditors, staff from seen s asof join accounts a on s.o_custkey = a.o_custkey and s.born >= a.made_up),
 frame as (select o_orderkey, cast(year(made_up) as int) as acc_year, case when event and days <= 120 then 1 else 0 end as label, case when equity < 0 then 1.0 else 0.0 end::double as negative_equity, case when current > 0 then cash / current end as cash_share,
  case when current < creditors then 1.0 else 0.0 end::double as negative_capital, ln(1 + greatest(0, least(staff, 100))) as log_staff, case when year(made_up) between 1996 and 1998 then 'train' when year(made_up) = 1999 then 'test' end as part
  from met where days >= 0 and (event and days <= 120 or days > 120))"""
#: A fixed score of the frame, for the query whose SQL has no fit.
SCORE = {"negative_equity": 0.8, "cash_share": -0.5, "negative_capital": 0.4, "log_staff": 0.3}


def exit_frame(s, d):
    """Orders as lives that end with the customer's next order; accounts are what the customer was shipped on a day."""
    orders = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.to_date("o_orderdate").alias("born"))
    p = C("l_extendedprice")
    shipped = table(s, d, "lineitem").join(orders.select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey")).groupBy("o_custkey", F.to_date("l_shipdate").alias("made_up"))
    accounts = shipped.agg(
        (F.sum(p) - 40000).alias("equity"), F.sum(p * C("l_discount")).alias("cash"), F.sum(p * 0.05).alias("current"), F.sum(p * C("l_tax")).alias("creditors"), F.sum("l_quantity").alias("staff")
    )
    died = F.lead("born").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    lives = orders.withColumn("died", died).select("o_orderkey", "o_custkey", "born", F.datediff(F.coalesce("died", F.to_date(F.lit("2001-08-01"))), C("born")).alias("days"), C("died").isNotNull().alias("event"))
    columns = {c: c for c in ("equity", "cash", "current", "creditors", "staff")}
    # a customer has accounts of a day once, so only orders can crowd one
    crowded = orders.groupBy("o_custkey").count().where("count > 1000000")
    return prediction.exit_frame(lives, accounts, "o_custkey", "born", "days", "event", "made_up", ["made_up"], columns, (1996, 1998), 1999, 120, crowded)


@query("Q83_exit_frame", f"with {ACCOUNTS_SQL} select o_orderkey, acc_year, label, negative_equity, round(cash_share, 6) as cash_share, negative_capital, round(log_staff, 6) as log_staff, part from frame where part is not null and cash_share is not null")
def q83(s, d):
    return exit_frame(s, d).select("o_orderkey", "acc_year", "label", "negative_equity", r6("cash_share").alias("cash_share"), "negative_capital", r6("log_staff").alias("log_staff"), "part")


@query(
    "Q83b_exit_deciles",
    f"""with {ACCOUNTS_SQL}, x as (select round({' + '.join(f"{w} * {c}" for c, w in SCORE.items())}, 9) as score, label as y from frame where part = 'test' and cash_share is not null),
 r as (select score, count(*) as ties, sum(y) as ones from x group by 1), m as (select *, coalesce(sum(ties) over (order by score rows between unbounded preceding and 1 preceding), 0) + (ties + 1) / 2 as mid from r),
 a as (select sum(ones) as n1, sum(ties) - sum(ones) as n0, sum(ones * mid) as r from m), q as (select quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from x), e as (select distinct unnest(edges) as edge from q)
 select 'auc' as part, 0 as decile, cast(n1 + n0 as bigint) as n, round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6) as value from a
 union all select 'decile', cast(dec as int), count(*), round(avg(y), 6) from (select y, 1 + (select count(*) from e where edge < score) as dec from x) group by dec""",
)
def q83b(s, d):
    score = sum((F.lit(w) * C(c) for c, w in SCORE.items()), F.lit(0.0))
    return prediction.deciles(exit_frame(s, d).where("part = 'test'").withColumn("score", F.round(score, 9)), "score", "label").withColumn("value", r6("value"))


@query("Q83r_exit_prediction")
def q83r(s, d):
    """Fitted on the training years, scored on the test year: terms, area under the curve and tenths."""
    frame = exit_frame(s, d).select("label", "part", *SCORE).persist()
    fit = logit.irls(frame.where("part = 'train'"), list(SCORE), "label")
    tested = prediction.deciles(logit.predicted(frame.where("part = 'test'"), fit), "score", "label")
    frame.unpersist()
    return fit.select(C("term").alias("part"), F.lit(None).cast("int").alias("decile"), F.lit(None).cast("long").alias("n"), C("coefficient").alias("value")).unionByName(tested)
