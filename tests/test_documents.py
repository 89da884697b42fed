"""Figures out of markup, sheets and texts, by hand-made cases."""

import re
import zipfile

import pytest

from quarrystone.functions import candidates
from quarrystone.sources import markup, sheets


def fact(name, value, context="new", **attrs):
    more = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f'<ix:nonFraction name="uk:{name}" contextRef="{context}"{more}>{value}</ix:nonFraction>'


def read(*body):
    contexts = '<xbrli:context id="old"><p><startDate>2019-02-01</startDate><endDate>2020-01-31</endDate></p></xbrli:context><context id="new"><instant>2021-01-31</instant></context><context id="none"></context>'
    columns = [c.split()[0] for c in re.split(r", (?![^<]*>)", markup.FACTS)]
    return dict(zip(columns, markup.parsed(f"<html><head><title>A &amp; B</title></head><body>{contexts}{''.join(body)}</body></html>")))


@pytest.mark.parametrize(("field", "names"), markup.NAMES.items())
def test_every_name(field, names):
    for name in names:
        got = read(fact(name, "1,234", sign="-", scale="3"))
        assert got["facts"] == {field: -1234000.0} and got["sources"] == {field: name} and got["as_of"] == {field: "2021-01-31"}
        assert read(fact(name.lower(), "1"))["facts"] == {}  # names are told apart by case
    assert len(markup.FIELD_OF) == 32


def test_precedence():
    assert read(fact("Equity", 1, "old"), fact("Equity", 2), fact("Equity", 3, "old"), fact("Equity", 4, "none"))["facts"] == {"equity": 2.0}  # the latest day, and a dated one
    assert read(fact("Equity", 2), fact("ShareholderFunds", 5))["facts"] == {"equity": 5.0}  # at one day the later
    assert read(fact("Equity", 1, "none"), fact("Equity", 2, "nowhere"))["facts"] == {"equity": 2.0}
    weak = fact("NetCurrentAssetsLiabilities", 7)
    strong = fact("NetAssetsLiabilities", 9)
    for body in ((weak, strong), (strong, weak)):
        got = read(*body)
        assert got["facts"] == {"net_assets": 9.0} and not got["weak_net_assets"] and got["sources"] == {"net_assets": "NetAssetsLiabilities"}
    assert read(weak)["weak_net_assets"] and read(weak)["facts"] == {"net_assets": 7.0}
    assert read(weak, fact("NetAssetsLiabilities", 9, "old"))["facts"] == {"net_assets": 7.0}  # an earlier day displaces nothing
    assert read(fact("NetAssetsLiabilities", 9, "old"), weak)["facts"] == {"net_assets": 9.0}


def test_references_end_in_a_semicolon():
    """As in Q05c's SQL; a title that is cut within a reference stays as it is."""
    title = lambda t: markup.parsed(f"<title>{t}</title>")[0]
    assert [title(t) for t in ("a &amp; b&amp", "a&lt", "&ltb;", "&am", "a & b&", "&amp;lt;", "&#65;&#x42;&#65", "&ampx;&no;")] == ["a & b&amp", "a&lt", "&ltb;", "&am", "a & b&", "&lt;", "AB&#65", "&ampx;&no;"]
    assert markup.parsed('<title>x&amp</title><a href="?a=1&amp;b=2&lt">y</a>')[:2] == ("x&amp", 1)


def test_whole_document():
    got = read(fact("Other", 1), fact("Creditors", "(48,215)"), fact("Cash", 3), fact("Debtors", "none"), '<a href="x">y</a><a>z</a>', fact("Turnover", f"1{fact('Equity', '2')}", "old"))
    assert got["title"] == "A & B" and got["links"] == 1 and got["facts_seen"] == 6
    assert got["facts"] == {"creditors_within_one_year": -48215.0, "turnover": 12.0, "equity": 2.0} and got["balance_sheet_date"] == "2021-01-31"
    assert read()["balance_sheet_date"] == "2021-01-31" and read()["facts"] == {}  # of the contexts alone
    assert markup.parsed(None)[2:] == ({}, {}, {}, 0, False, None)
    assert markup.parsed('<context id="c"><instant>2020-01-01</instant></context><ix:nonFraction name="Equity" contextRef="c">5')[2] == {"equity": 5.0}  # left open
    assert markup.parsed("<p>" * 50_000 + "</div>" * 50_000)[1] == 0


@pytest.mark.parametrize(("text", "scale", "sign", "want"), [
    ("1,234.5", None, None, 1234.5), ("£ 12", "2", None, 1200.0), ("(7)", None, None, -7.0), ("(7)", None, "-", -7.0), ("-7", None, "-", 7.0), ("-", None, None, None), ("", "3", None, None), ("1.2.3", None, None, None),
    ("3-4", None, None, None), ("5", "x", None, 5.0), ("5", "-1", None, 0.5), ("a 5 b", None, "+", 5.0), ("(0)", None, None, 0.0),
])
def test_numbers(text, scale, sign, want):
    assert markup.number(text, scale, sign) == want


def workbook(path, pages, shared=True):
    """pages: {sheet: {reference: text or number}}"""
    words = sorted({v for cells in pages.values() for v in cells.values() if isinstance(v, str)})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(pages, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(pages) + 1)) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{w[:1]}</t></r><r><t>{w[1:]}</t></r></si>" for w in words) + "</sst>")
        for i, cells in enumerate(pages.values(), 1):
            rows = {}
            for ref, v in cells.items():
                c = f'<c r="{ref}"><v>{v}</v></c>' if not isinstance(v, str) else f'<c r="{ref}" t="s"><v>{words.index(v)}</v></c>' if shared else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
                rows.setdefault(int(re.sub(r"\D", "", ref)), []).append(c)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r}">{"".join(c)}</row>' for r, c in sorted(rows.items())) + "</sheetData></worksheet>")


def test_shifted_headers(spark, tmp_path):
    """The same table under other titles, in other columns, with headers stacked in other rows."""
    workbook(tmp_path / "a.xlsx", {
        "Notes": {"A1": "About", "B3": "Station", "A4": "LU", "B4": "Nowhere"},
        "Data": {"A1": "Counts", "A2": "(c)", "C4": "Annualised", "A5": "Mode", "B5": " STATION ", "C5": "entries", "C6": "total", "A7": " lu", "B7": "Bank", "C7": 100, "A8": "LU", "B8": "Oval", "C8": "n/a", "A9": "NR", "B9": " Acton ", "C9": "7.5", "C10": 9},
        "Later": {"A1": "x", "B2": "station", "C2": "annualised", "B3": "Never", "C3": 1},
    })
    workbook(tmp_path / "b.xlsx", {"2021": {"A1": "t", "D9": "Station", "AB9": "Weekday", "AB10": "ANNUALIS. in+out", "AC8": "annualised", "D12": "Bank", "AC12": 12.5, "AB12": 1, "A12": "lu"}}, shared=False)
    workbook(tmp_path / "c.xlsx", {"low": {f"A{r}": "pad" for r in range(1, 15)} | {"A15": "Station", "B15": "annualised", "A16": "x", "B16": 1}})
    (tmp_path / "d.xlsx").write_bytes(b"no workbook")
    cells = sheets.cells(spark, str(tmp_path / "*.xlsx"))
    assert {(r.row, r.column, r.text, r.number) for r in cells.where("sheet = '2021' and row = 11").collect()} == {(11, 3, "Bank", None), (11, 28, "12.5", 12.5), (11, 27, "1", 1.0), (11, 0, "lu", None)}
    got = {(r.path[-6:], r.sheet, r.row, r["first"], r.label, r.value) for r in sheets.stacked_table(cells, "station", "annualis").collect()}
    assert got == {("a.xlsx", "Data", 6, "LU", "Bank", 100.0), ("a.xlsx", "Data", 8, "NR", "Acton", 7.5), ("b.xlsx", "2021", 11, "LU", "Bank", 12.5)}
    assert sheets.stacked_table(cells.where("false"), "station", "annualis").count() == 0


def test_columns():
    assert [sheets.column_of(x) for x in ("A1", "Z9", "AA3", "AB12", "XFD1")] == [0, 25, 26, 27, 16383]


TEXT = "Intro\n\n  Group  revenue\t 1,234.5 up \nnothing\r\nTurnover fell\n12,000\nThe VAT and eat-in vat rules; VALUE ADDED TAX\n" + "Sales 100\n" * 50


def lines(text, most=40):
    flat = re.sub(r"[ \t]+", " ", text or "")
    kept = [x for x in (y.strip(" ") for y in flat.splitlines()) if x]
    hits = [i for i, x in enumerate(kept) if re.search(candidates.TOP_LINE, x, re.I) and re.search(candidates.MONEY, x)][:most]
    return [(i + 1, kept[i][:200], kept[i - 1][:200] if i else None, kept[i + 1][:200] if i + 1 < len(kept) else None) for i in hits]


def around(text, most=40, context=220):
    flat = re.sub(r"[ \t]+", " ", text or "")
    out = [(t, m.start(), re.sub(r"\s+", " ", flat[max(0, m.start() - context // 2) : m.start() + context]).strip()) for t in candidates.TAX for m in re.finditer(t, flat, re.I)]
    return [(n, *x) for n, x in enumerate(out[:most], 1)]


def test_candidates(spark):
    rows = [(1, TEXT), (2, None), (3, ""), (4, "takeaway " * 60 + "VAT"), (5, "x" * 300 + " Sales 999 " + "y" * 300), (6, "Revenue 100"), (7, "zero-rated, Zero rated; standard rated VATs eat in")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "k long, t string, n int")
    got = sorted(map(tuple, candidates.figure_lines(df, "k", "t").collect()))
    assert got == sorted((k, *x) for k, t in rows for x in lines(t)) and len(got) > 40
    got = sorted(map(tuple, candidates.snippets(df, "k", "t").collect()))
    assert got == sorted((k, *x) for k, t in rows for x in around(t)) and len(got) > 45
    assert candidates.snippets(df.where("false"), "k", "t").count() == 0
