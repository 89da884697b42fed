"""What a register study reads beside its main file: sectors of the bulk file, typed tables, establishments by authority, an index of filings, and lookups of keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrystone.functions.normalise import address_key, postcode, postcode_area
from quarrystone.sources.paged import Lane, called

#: Fixed value: how a classification code stands at the beginning of its text.
CODE = r"^\s*(\d{4,5})"


def typed_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of ``schema`` by name, wherever they stand, header names stripped, undecodable bytes replaced; a field that is not of its type is null.

    Only the columns asked for are parsed.
    """
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    named = raw.toDF(*(c.strip() for c in raw.columns))
    have = set(named.columns)
    return named.select(*(F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if f.name in have and f.dataType.typeName() != "string" else (F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def sector_scan(bulk: DataFrame, sectors: list[str], areas: list[str], slots: list[str], number: str, status: str, born: str, code: str, line1: str, line2: str) -> DataFrame:
    """company_number, sector, status, incorporated, postcode, address_key of the rows of a bulk scan in these sectors and postcode areas.

    The sector is the first slot's code that is one of them, in the order of the slots. Both filters are column expressions over the scan; nothing is shuffled.
    """
    quoted = lambda c: F.col(f"`{c}`")
    codes = F.transform(F.array(*map(quoted, slots)), lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), CODE, 1))
    sector = F.try_element_at(F.filter(codes, lambda c: c.isin(*sectors)), F.lit(1))
    pc = postcode(quoted(code))
    text = lambda c: F.trim(F.coalesce(quoted(c), F.lit("")))
    kept = bulk.where(sector.isNotNull() & (pc != "") & postcode_area(pc).isin(*areas))
    return kept.select(text(number).alias("company_number"), sector.alias("sector"), text(status).alias("status"), text(born).alias("incorporated"), pc.alias("postcode"), address_key(quoted(line1), quoted(line2), pc).alias("address_key"))


#: What stands around an authority's own name, and the one that keeps its city.
AROUND = ["london borough of ", "royal borough of ", " corporation", " council"]
RENAMED = {"city of westminster": "westminster"}


def authority_name(c: Column) -> Column:
    """'London Borough of Kingston-upon-Thames' to 'kingston upon thames'."""
    name = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for x in AROUND:
        name = F.replace(name, F.lit(x), F.lit(""))
    for x, y in RENAMED.items():
        name = F.replace(name, F.lit(x), F.lit(y))
    return F.trim(F.replace(name, F.lit("-"), F.lit(" ")))


def authorities(served: DataFrame, wanted: list[str], name: str = "name") -> DataFrame:
    """The rows of a service's authorities that are wanted, under any of their names."""
    return served.where(authority_name(F.col(name)).isin(*wanted) | F.lower(F.trim(F.col(name))).isin(*wanted))


#: What is read of an establishment.
ESTABLISHMENT = "FHRSID long, BusinessName string, BusinessType string, AddressLine1 string, AddressLine2 string, AddressLine3 string, AddressLine4 string, PostCode string"


def establishments(items: DataFrame, authority: str = "slice", item: str = "item") -> DataFrame:
    """A row for each establishment and candidate address key: fhrsid, business_name, business_type, authority, addr1, addr2, postcode, address_key.

    items: JSON of a paged source, a slice for each authority. Which line holds the street differs, so every line with the one behind it is a candidate, and all lines
    joined; the postcode is part of every key, and those without one have none.
    """
    e = F.from_json(item, ESTABLISHMENT)
    rows = items.select(F.col(authority).alias("authority"), e.alias("e"))
    text = lambda c: F.trim(F.coalesce(F.col(f"e.{c}"), F.lit("")))
    lines = [text(f"AddressLine{i}") for i in (1, 2, 3, 4)]
    pc = postcode(F.col("e.PostCode"))
    pairs = [address_key(a, b, pc) for a, b in zip(lines, [*lines[1:], F.lit("")])]
    joined = F.array_join(F.filter(F.array(*lines), lambda x: x != ""), " ")
    keys = F.array_distinct(F.filter(F.array(*pairs, address_key(joined, F.lit(""), pc)), lambda k: k != ""))
    out = rows.where(pc != "").select(
        F.col("e.FHRSID").alias("fhrsid"), text("BusinessName").alias("business_name"), text("BusinessType").alias("business_type"), "authority", lines[0].alias("addr1"), lines[1].alias("addr2"), pc.alias("postcode"), F.explode(keys).alias("address_key")
    )
    return out


def accounts_index(filings: DataFrame, earliest: str, folder: str) -> DataFrame:
    """entity, made_up_to, type, filed, document, place of the accounts to be fetched: filings as histories() gives them, with the link to the document's description.

    The day that accounts are made up to is the one stated, else that of the action, else that of filing; of those from ``earliest`` on, the ones with a document. ``place`` is
    where it is to be kept; of filings that share a place the latest counts.
    """
    made = F.coalesce("item.description_values.made_up_date", "item.action_date", "item.date")
    document = F.regexp_extract(F.rtrim("item.links.document_metadata", F.lit("/")), r"([^/]+)$", 1)
    kind = F.coalesce("item.type", F.lit("AA"))
    rows = filings.where((F.col("item.category") == "accounts") & (made >= earliest) & (document != "")).select("entity", made.alias("made_up_to"), F.col("item.type").alias("type"), F.col("item.date").alias("filed"), document.alias("document"), F.concat(F.lit(f"{folder}/"), "entity", F.lit("/"), made, F.lit("_"), kind, F.lit(".pdf")).alias("place"))
    return rows.groupBy("place").agg(F.max_by(F.struct("entity", "made_up_to", "type", "filed", "document"), F.struct("filed", "document")).alias("x")).select("x.*", "place")


def lookups(keys: DataFrame, table: str, bulk: str, single: str | None = None, size: int = 100, lanes: int = 8, rate: float = 0.0) -> DataFrame:
    """key, answer (JSON, null for what nothing knows) of every distinct key: from the table of earlier answers, else asked for in tasks and added to it.

    bulk and single are functions (module:function): bulk takes ``size`` keys and gives a dict of those it knows, single one key that bulk does not know (one that went out of
    use). Keys are asked once, whatever they give; a run that broke off leaves the table as it was, and asks again. All tasks together keep to ``rate`` calls a second.
    """
    spark = keys.sparkSession
    wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("key")).where("key is not null and key <> ''").distinct()

    def known() -> DataFrame:
        try:
            return spark.read.schema("key string, answer string").parquet(table)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], "key string, answer string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        many, one = called(bulk), called(single) if single else None
        lane = Lane(TaskContext.get().partitionId() % lanes, lanes, rate)

        def asked(part: list[str]) -> pd.DataFrame:
            lane.wait()
            found = many(part)
            answers = []
            for k in part:
                answer = found.get(k)
                if answer is None and one is not None:
                    lane.wait()
                    answer = one(k)
                answers.append(None if answer is None else json.dumps(answer, sort_keys=True))
            return pd.DataFrame({"key": part, "answer": answers})

        held: list[str] = []
        for pdf in batches:
            held += pdf["key"].tolist()
            while len(held) >= size:
                yield asked(held[:size])
                held = held[size:]
        if held:
            yield asked(held)

    missing = wanted.join(known(), "key", "left_anti")
    missing.repartition(lanes, "key").sortWithinPartitions("key").mapInPandas(run, "key string, answer string").write.mode("append").parquet(table)
    return wanted.join(known().groupBy("key").agg(F.max("answer").alias("answer")), "key", "left")
