"""Where a long text speaks of something: lines that name it beside a figure, and snippets around its terms. Column expressions over one row's text; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a figure looks like, and the words of a top line.
MONEY = r"-?[\d,]{3,}(?:\.\d)?"
TOP_LINE = r"\b(?:Revenue|Turnover|Total revenue|Group revenue|Sales)\b"
#: Terms that tell of the tax.
TAX = [r"\bVAT\b", r"value added tax", r"zero[- ]rated", r"standard[- ]rated", r"eat[- ]in", r"takeaway", r"take[- ]away"]


def squashed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t]+", " ")


def figure_lines(docs: DataFrame, key: str, text: str, words: str = TOP_LINE, most: int = 40, width: int = 200) -> DataFrame:
    """key, n, line, before, after: the first ``most`` lines of a text that hold one of the words, in any case, and a figure, with the lines next to them.

    Lines are stripped, and blank ones do not count, as neighbours neither; n numbers the lines that do from 1; neighbours of an edge are null.
    """
    lines = F.filter(F.transform(F.split(squashed(F.col(text)), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(x)), lambda x: x != "")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    hit = lambda x: x["line"].rlike(f"(?i){words}") & x["line"].rlike(MONEY)
    rows = docs.select(F.col(key), lines.alias("__lines"), F.slice(F.filter(numbered, hit), 1, most).alias("__hits"))
    at = lambda i: F.substring(F.try_element_at("__lines", i), 1, width)
    out = rows.select(key, "__lines", F.explode("__hits").alias("__hit"))
    n = F.col("__hit.n")
    return out.select(key, n.alias("n"), F.substring("__hit.line", 1, width).alias("line"), F.when(n > 1, at(F.when(n > 1, n - 1).otherwise(1))).alias("before"), at(n + 1).alias("after"))


def snippets(docs: DataFrame, key: str, text: str, terms: list[str] = TAX, most: int = 40, context: int = 220) -> DataFrame:
    """key, n, term, place, snippet: the first ``most`` places of the terms in a text, by term and then by place, each with the text from half of ``context`` before it to
    ``context`` behind its start, white space squashed. place counts characters from 0 of the text with its blanks squashed.
    """
    flat = squashed(F.col(text))

    def places(term: str) -> Column:
        # the text between the matches tells where they are
        between, found = F.slice(F.split(flat, f"(?i){term}", -1), 1, most), F.slice(F.regexp_extract_all(flat, F.lit(f"(?i){term}"), F.lit(0)), 1, most)
        length = lambda x, n: F.aggregate(F.slice(x, F.lit(1), n), F.lit(0), lambda a, t: a + F.length(t))
        return F.transform(found, lambda _, i: F.struct(F.lit(term).alias("term"), (length(between, i + 1) + length(found, i)).alias("at")))

    hits = F.slice(F.concat(*(places(t) for t in terms)), 1, most)
    rows = docs.select(key, flat.alias("__flat"), F.posexplode(hits).alias("__i", "__hit"))
    at = F.col("__hit.at")
    start = F.greatest(F.lit(0), at - context // 2)
    snippet = F.trim(F.regexp_replace(F.substring(F.col("__flat"), start + 1, at + context - start), r"\s+", " "))
    return rows.select(key, (F.col("__i") + 1).alias("n"), F.col("__hit.term").alias("term"), at.alias("place"), snippet.alias("snippet"))
