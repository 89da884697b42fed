"""Keys of postcodes, addresses and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Post towns that end a street line in one register and not in another.
TOWNS = ["LONDON", "GREATER LONDON", "MIDDLESEX", "MIDDX", "ESSEX", "SURREY", "KENT", "HERTS", "HERTFORDSHIRE", "UNITED KINGDOM", "UK", "ENGLAND"]
#: Words that end a street name, full and abbreviated.
STREETS = (
    "ROAD RD STREET ST AVENUE AVE LANE LN CLOSE DRIVE DR WAY PLACE PL COURT CT ROW GARDEN GARDENS GDN GDNS GROVE HILL WALK RISE CRESCENT CRES "
    "TERRACE PARADE BROADWAY MEWS BUILDING BUILDINGS CHAMBER CHAMBERS HOUSE YARD GATE WHARF SQUARE SQ CIRCUS PRECINCT CENTRE CENTER QUAY BANK "
    "VILLA VILLAS MARKET GREEN COMMON PARK"
).split()
#: What names a part of a building, with up to four letters or digits behind it.
UNITS = [
    "UNIT", "SUITE", "FLAT", "APT", "APARTMENT", "ROOM", "OFFICE", "SHOP", "STUDIO", "FLOOR", r"GROUND\s+FLOOR", r"FIRST\s+FLOOR", r"SECOND\s+FLOOR",
    "BASEMENT", r"REAR\s+OF", r"PART\s+(?:GROUND|FIRST|SECOND)\s+FLOOR",
]
UNIT = rf"^\s*(?:{'|'.join(UNITS)})\s*[-:,]?\s*\w{{0,4}}\s*[-:,]?\s*"
#: The marks of an agent, at a line's beginning and behind its number.
CARE_OF, BEHIND_NUMBER = r"(?i)^\s*(?:C/O|C\.O\.?|CARE\s+OF)\s+", r"(?i)^(\S+)\s+C[/.]O\s+"
#: Behind an agent's name: the house number and all after it.
NUMBERED = r"[,\s](\d+[A-Z]?\s+\w.*)$"


def upper(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def postcode(c: Column) -> Column:
    """'n120nl' to 'N12 0NL'; empty if it cannot be a postcode."""
    pc = F.regexp_replace(upper(c), "[^A-Z0-9]", "")
    n = F.length(pc)
    return F.when(n.between(5, 7), F.concat(F.substring(pc, F.lit(1), n - 3), F.lit(" "), F.substring(pc, n - 2, F.lit(3)))).otherwise("")


def postcode_district(c: Column) -> Column:
    return F.get(F.split(F.trim(upper(c)), r"\s+"), F.lit(0))


def postcode_area(c: Column) -> Column:
    return F.regexp_extract(F.trim(upper(c)), "^([A-Z]{1,2})", 1)


def plain(c: Column) -> Column:
    """Upper case, punctuation and runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(upper(c), r"[^\w\s]", " "), r"\s+", " "))


def care_of(line1: Column, line2: Column) -> Column:
    """struct(address, agent) of two address lines: the address without an agent that mail goes through, and that agent's name or null.

    'C/O Smith Ltd, 12 High Street' is cut at the first number behind the mark; without one, the address is the second line.
    '12 C/O Smith and Co High Street' keeps the number, the last street word and the word before it; without a street word, all but the mark.
    An empty first line gives the second. Other lines, such as those with the mark further on, stay as they are.
    """
    one, two = F.trim(F.coalesce(line1, F.lit(""))), F.trim(F.coalesce(line2, F.lit("")))
    rest = F.trim(F.regexp_replace(one, CARE_OF, ""))
    numbered = F.regexp_extract(rest, NUMBERED, 1)
    before = F.trim(F.substring(rest, F.lit(1), F.length(rest) - F.length(numbered) - 1))
    # greedy, so the street word found is the last one
    types = "|".join(STREETS)
    street = rf"{BEHIND_NUMBER}((?:.*\s)?)(\S+\s+(?:{types}))(?:\s.*)?$"
    alone = rf"{BEHIND_NUMBER}({types})(?:\s.*)?$"

    def joined(address: Column, agent: Column) -> Column:
        agent = F.trim(F.regexp_replace(agent, r"\s+", " "))
        return F.struct(address.alias("address"), F.when(agent != "", agent).alias("agent"))

    none = F.lit(None).cast("string")
    return (
        F.when(one == "", joined(two, none))
        .when(one.rlike(CARE_OF) & (numbered != ""), joined(F.trim(numbered), before))
        .when(one.rlike(CARE_OF), joined(two, rest))
        .when(one.rlike(street), joined(F.regexp_replace(one, street, "$1 $3"), F.regexp_extract(one, street, 2)))
        .when(one.rlike(alone), joined(F.regexp_replace(one, alone, "$1 $2"), none))
        .otherwise(joined(F.regexp_replace(one, BEHIND_NUMBER, "$1 "), none))
    )


def address_key(line1: Column, line2: Column, pc: Column) -> Column:
    """'STREET|POSTCODE' without agent, unit and trailing towns; empty without a postcode or street."""
    code = F.regexp_replace(upper(pc), r"\s+", "")
    street = plain(F.regexp_replace(F.upper(care_of(line1, line2)["address"]), UNIT, ""))
    street = F.when(street == "", plain(line2)).otherwise(street)
    street = F.trim(F.regexp_replace(street, rf"(\s+({'|'.join(TOWNS)}))+$", ""))
    return F.when((code == "") | (street == ""), "").otherwise(F.concat(street, F.lit("|"), code))


def candidate_keys(lines: list[Column], pc: Column) -> Column:
    """Distinct keys of an establishment: every line before the next one, and all lines joined."""
    pairs = [address_key(a, b, pc) for a, b in zip(lines, [*lines[1:], F.lit("")])]
    return F.array_distinct(F.filter(F.array(*pairs, address_key(F.concat_ws(" ", *lines), F.lit(""), pc)), lambda k: k != ""))


def company_name(c: Column) -> Column:
    """AND for &, no punctuation, no legal form at the end."""
    name = plain(F.regexp_replace(upper(c), "&", " AND "))
    return F.trim(F.regexp_replace(name, r"\s+(LIMITED|LTD|PLC|LLP)$", ""))


def company_name_loose(c: Column) -> Column:
    """The older rule: every THE, LTD and LIMITED goes, & is a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(plain(F.regexp_replace(upper(c), "&", " ")), r"\b(THE|LTD|LIMITED)\b", " "), r"\s+", " "))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")
