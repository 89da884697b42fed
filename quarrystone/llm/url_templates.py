"""Operator 3: URL filtering by a tree of path templates, in DataFrame operations only.

Given rules decide first: a rule fits its host and all subdomains if the path starts with the rule's path; the longest rule wins. Urls
that rules decide are the labelled ones. For the rest a tree of templates is learnt, host by host, a level for each segment of the path:

* *Wildcards.* Where the children of a branch are too many for its rows (more than ``VARIED`` distinct ones, and more than one for ``ROWS``
  rows), the segment is variable: children become ``*``, but for those that hold one in ``VARIED`` of the branch's rows, or are empty.
* *Merging.* Siblings are put in order of their share of blocked labelled urls, in steps of ``1 / STEPS``. Neighbours whose shares do not
  differ by ``Z`` standard errors (two proportions, pooled) are one branch from there on: below it they share their children.
* *Purity.* A branch's purity is that of its parent if its share lies within ``Z`` standard errors of it, else its share, smoothed by
  ``WEIGHT`` urls of the parent's purity. The parent of a host's first branches is the same template over all hosts, that of these is the
  whole table; merged branches have the mean of their parents, by labelled urls.
* A path is rejected if the purity of its last branch is above one half.

The tree goes down to the deepest segment. A branch ends early if it has no labelled url, or one path alone: nothing below it could differ.
A round of Spark makes a level and writes it, so plans stay as small as one level. Segments that all paths of a branch share, and where none of them ends, are
gone through at once, with the purity of each of their levels: rounds follow the branchings and ends of paths, not their depth. Rows are counted by path before any join;
joins of paths with their branch are dealt in ``SALTS`` places, so a host with a third of all rows is no single task's.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the verdict of the template with no segments;
repeated rows are judged alike; ids may be null; slashes before the first segment count as one; without labelled urls all that no rule blocks is
allowed; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import released, stored, table

#: verdict, host, path
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
VARIED, ROWS, WEIGHT, Z, STEPS, SALTS = 8, 4, 4, 1.96, 64, 16
#: Levels that the SQL goes down; it equals the operator on tables with no more segments.
SQL_LEVELS = 4
#: Purities are rounded to so many digits, so that the order of a sum decides nothing.
DIGITS = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parted(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def purity(p: Column | None = None) -> Column:
    """A branch's purity, from its labelled and blocked urls and its parent's purity (else the column prior)."""
    p, labelled = F.col("prior") if p is None else p, F.greatest("labelled", F.lit(1))
    share = F.col("blocked") / labelled
    alike = F.abs(share - p) <= Z * F.sqrt(p * (1 - p) / labelled)
    return F.when((F.col("labelled") == 0) | alike, p).otherwise(F.round((F.col("blocked") + WEIGHT * p) / (F.col("labelled") + WEIGHT), DIGITS))


def counted(frame: DataFrame, *by: str | Column) -> DataFrame:
    return frame.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked", "paths")))


def met(many: DataFrame, few: DataFrame, on: list[str], by: str) -> DataFrame:
    """Left join in SALTS places for each key, the place of a row being decided by its column ``by``."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, "salt"], "left").drop("salt")


def leaps(nodes: DataFrame) -> DataFrame:
    """node, leap, leapt of the branches with one child that can go down several levels at once, and their purity there.

    All paths of a branch lie between the first and the last in order, so they share what these share; where a path ends, the branch is counted anew.
    """
    shared = F.array_position(F.zip_with(F.split("low", "/"), F.split("high", "/"), lambda x, y: x.eqNullSafe(y)), False) - 1
    leap = F.least(F.when(shared < 0, F.col("left")).otherwise(shared), F.col("left") - 1).cast("int")
    some = nodes.where("children = 1 and paths > 1 and labelled > 0").withColumn("leap", leap).where("leap > 0")
    return some.select("node", "leap", F.aggregate(F.sequence(F.lit(1), F.col("leap")), F.col("prior"), lambda p, _: purity(p)).alias("leapt"))


def level(rows: DataFrame, depth: int, root: float) -> DataFrame:
    """The rows (paths of open branches: host, path, segments, at, n, labelled, blocked, paths, node, prior) one level further down, or several.

    at is the place of the next segment; node is the branch below, null if it ends here; prior is its purity.
    """
    rows = rows.withColumn("segment", F.coalesce(F.get("segments", F.col("at")), F.lit("")))
    rest, left = F.array_join(F.slice("segments", F.col("at") + 1, F.greatest(F.size("segments"), F.lit(1))), "/"), F.size("segments") - F.col("at")
    more = [F.min(rest).alias("low"), F.max(rest).alias("high"), F.min(left).alias("left"), F.max("prior").alias("prior"), *(F.sum(c).alias(c) for c in ("labelled", "blocked", "paths"))] if depth else []
    children = stored(rows.groupBy("node", "segment").agg(F.sum("n").alias("n"), *more))
    nodes = children.groupBy("node").agg(F.count("*").alias("children"), F.sum("n").alias("whole"), *(F.first(c).alias(c) for c in children.columns[3:]))
    varied = nodes.where((F.col("children") > VARIED) & (F.col("children") * ROWS > F.col("whole"))).select("node", "children", "whole")
    # of a variable segment's children, VARIED at most can hold one in VARIED of the rows
    fixed = met(children.select("node", "segment", "n"), varied, ["node"], "segment").where("whole is not null").groupBy("node").agg(F.collect_set(F.when((F.col("n") * VARIED >= F.col("whole")) | (F.col("segment") == ""), F.col("segment"))).alias("fixed"))
    known = fixed.withColumns({"leap": F.lit(None).cast("int"), "leapt": F.lit(None).cast("double")})
    if depth:
        known = known.unionByName(leaps(nodes), allowMissingColumns=True)
    template = F.when(F.col("fixed").isNotNull() & ~F.array_contains("fixed", F.col("segment")), F.lit("*")).otherwise(F.col("segment"))
    whole = stored(met(rows, known, ["node"], "path").withColumn("template", template).drop("fixed"))
    rows, leapt = whole.where("leap is null").drop("leap", "leapt"), whole.where("leap is not null")
    templates = rows.groupBy("node", "template").agg(F.max("prior").alias("prior"), *(F.sum(c).alias(c) for c in ("n", "labelled", "blocked", "paths")))
    if depth == 0:
        over = counted(templates, "template").withColumn("prior", F.lit(root)).select("template", purity().alias("prior"))
        templates = met(templates.drop("prior"), over, ["template"], "node")
    step = F.floor(STEPS * F.col("blocked") / F.col("labelled"))
    templates = stored(templates.withColumn("step", F.when(F.col("labelled") > 0, step)))
    # at most STEPS + 1 rows of a branch are put in order
    steps = templates.where("labelled > 0").groupBy("node", "step").agg(F.sum(F.col("labelled") * F.col("prior")).alias("weighed"), *(F.sum(c).alias(c) for c in ("labelled", "blocked", "paths")))
    order = Window.partitionBy("node").orderBy("step")
    before, b = F.lag("labelled").over(order), F.lag("blocked").over(order)
    pooled = (F.col("blocked") + b) / (F.col("labelled") + before)
    apart = F.abs(F.col("blocked") / F.col("labelled") - b / before) > Z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / before))
    steps = steps.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("branch", F.sum("apart").over(order))
    joint = Window.partitionBy("node", "branch")
    prior = F.round(F.sum("weighed").over(joint) / F.sum("labelled").over(joint), DIGITS)
    merged = steps.select("node", "step", "branch", prior.alias("prior"), *(F.sum(c).over(joint).alias(c) for c in ("labelled", "blocked")), F.sum("paths").over(joint).alias("below"))
    merged = merged.select("node", "step", "branch", "below", purity().alias("purity"))
    judged = met(templates, merged, ["node", "step"], "template").select("node", "template", "branch", "below", F.coalesce("purity", "prior").alias("purity"))
    out = met(rows, judged, ["node", "template"], "path")
    # a branch ends with those of its paths that end; the others go on together
    node = F.when((F.col("below") > 1) & (F.size("segments") > F.col("at") + 1), F.concat("node", F.lit("/"), F.col("branch")))
    kept = ["host", "path", "segments", "n", "labelled", "blocked", "paths"]
    out = out.select(*kept, node.alias("node"), F.col("purity").alias("prior"), (F.col("at") + 1).alias("at"))
    out = stored(out.unionByName(leapt.select(*kept, "node", F.col("leapt").alias("prior"), (F.col("at") + F.col("leap")).alias("at"))) if depth else out)
    released(children, whole, templates)
    return out


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = parted(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": name, "given": verdict})
    counts = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("given").alias("labelled"), F.count_if(F.col("given") == "block").alias("blocked"))
    rows = stored(counts.select("host", "path", F.split(F.ltrim("path", F.lit("/")), "/").alias("segments"), "n", "labelled", "blocked", F.lit(1).cast("long").alias("paths"), F.col("host").alias("node"), F.lit(0.0).alias("prior"), F.lit(0).alias("at")))
    labelled, blocked = rows.agg(F.sum("labelled"), F.sum("blocked")).first()
    root, depth, ended = round(blocked / labelled, DIGITS) if labelled else 0.0, 0, []
    while True:
        below = level(rows, depth, root)
        ended.append(below.where("node is null and labelled = 0").select("host", "path", (F.col("prior") > 0.5).alias("rejected")))
        rows, depth = below.where("node is not null"), depth + 1
        if rows.isEmpty():
            break
    judged = ended[0]
    for more in ended[1:]:
        judged = judged.unionByName(more)
    # rejected paths alone are needed; a path's rows are dealt by page
    rejected = judged.where("rejected")
    return met(urls, rejected, ["host", "path"], "page_id").select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same in DuckDB SQL, SQL_LEVELS segments down."""
    name, verdict = "", ""
    for kind, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
        name += f" when {fits} then '{h + p}'"
        verdict += f" when {fits} then '{kind}'"
    own = f"case when labelled = 0 or abs(blocked / greatest(labelled, 1) - prior) <= {Z} * sqrt(prior * (1 - prior) / greatest(labelled, 1)) then prior else round((blocked + {WEIGHT} * prior) / (labelled + {WEIGHT}), {DIGITS}) end"
    sums = "sum(n) as n, sum(labelled) as labelled, sum(blocked) as blocked, sum(paths) as paths"
    q = f"""
with a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select *, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as h from a),
c as (select page_id, translate(h, '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(substr(rest, length(h) + 1), '^[^?#]*'), '') as path from b),
u as (select *, case{name} end as rule, case{verdict} end as given from c),
r0 as (select host, path, string_split(ltrim(path, '/'), '/') as segments, count(*) as n, count(given) as labelled, count(*) filter (given = 'block') as blocked, 1 as paths, host as node, 0.0::double as prior from u group by all),
root as (select case when sum(labelled) > 0 then round(sum(blocked) / sum(labelled), {DIGITS}) else 0.0::double end as root from r0)"""
    for d in range(SQL_LEVELS):
        prior = f"(select template, {own} as prior from (select template, {sums}, max(root) as prior from t{d} cross join root group by template))" if d == 0 else f"(select distinct node, prior from r{d} where node is not null)"
        q += f""",
s{d} as (select *, coalesce(segments[{d + 1}], '') as segment from r{d} where node is not null),
c{d} as (select node, segment, {sums} from s{d} group by all),
v{d} as (select node, sum(n) as whole from c{d} group by node having count(*) > {VARIED} and count(*) * {ROWS} > sum(n)),
m{d} as (select c{d}.*, case when whole is not null and segment <> '' and n * {VARIED} < whole then '*' else segment end as template from c{d} left join v{d} using (node)),
t{d} as (select node, template, {sums} from m{d} group by all),
p{d} as (select t{d}.*, prior from t{d} join {prior} using ({'template' if d == 0 else 'node'})),
g{d} as (select node, floor({STEPS} * blocked / labelled) as step, sum(labelled * prior) as weighed, sum(labelled) as labelled, sum(blocked) as blocked, sum(paths) as paths from p{d} where labelled > 0 group by all),
h{d} as (select *, lag(labelled) over w as l, lag(blocked) over w as b from g{d} window w as (partition by node order by step)),
i{d} as (select *, sum(coalesce(cast(abs(blocked / labelled - b / l) > {Z} * sqrt((blocked + b) / (labelled + l) * (1 - (blocked + b) / (labelled + l)) * (1 / labelled + 1 / l)) as integer), 0)) over (partition by node order by step rows unbounded preceding) as branch from h{d}),
j{d} as (select node, branch, {own} as purity, below from (select node, branch, round(sum(weighed) / sum(labelled), {DIGITS}) as prior, sum(labelled) as labelled, sum(blocked) as blocked, sum(paths) as below from i{d} group by all)),
k{d} as (select p{d}.node, template, i{d}.branch, below, coalesce(purity, prior) as purity from p{d} left join i{d} on p{d}.node = i{d}.node and p{d}.labelled > 0 and floor({STEPS} * p{d}.blocked / p{d}.labelled) = step left join j{d} on i{d}.node = j{d}.node and i{d}.branch = j{d}.branch),
r{d + 1} as (select s.host, s.path, s.segments, s.n, s.labelled, s.blocked, s.paths, case when k.below > 1 and len(segments) > {d + 1} then s.node || '/' || cast(k.branch as varchar) end as node, k.purity as prior
  from s{d} s join m{d} m on s.node = m.node and s.segment = m.segment join k{d} k on s.node = k.node and m.template = k.template)"""
    ends = " union all ".join(f"select host, path, prior from r{d + 1} where labelled = 0" + (" and node is null" if d + 1 < SQL_LEVELS else "") for d in range(SQL_LEVELS))
    return q + f""",
e as ({ends})
select page_id, host, path, rule, coalesce(given, case when prior > 0.5 then 'block' else 'allow' end) as verdict from u left join e using (host, path)"""
