"""Files that a register comes in: bulk CSV, a folder of JSON histories, archives, monthly partitions."""

from __future__ import annotations

import io
import shutil
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One filing of an entity's history.
FILING = "array<struct<type: string, category: string, date: string, description: string, action_date: string, description_values: struct<change_date: string, old_address: string, new_address: string, made_up_date: string>>>"
CHARGE = "array<struct<created_on: string, status: string>>"


def bulk_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, header names stripped, undecodable bytes replaced; filters and column choice reach the scan."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').csv(path)
    return raw.toDF(*(c.strip() for c in raw.columns))


def histories(spark: SparkSession, path: str, item: str = FILING) -> DataFrame:
    """entity (the file's name), position, item: one scan of the folder, exploded once for every use."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("entity"), F.from_json("value", item).alias("items"))
    return whole.select("entity", F.posexplode("items").alias("position", "item"))


def filing_footprint(filings: DataFrame) -> DataFrame:
    """Of each entity: filings, accounts, confirmations, whether ever dormant, first accounts, first insolvency."""
    kind, text = F.col("item.category"), F.coalesce(F.col("item.description"), F.lit(""))
    return filings.groupBy("entity").agg(
        F.count("*").alias("n_filings"), F.count_if(kind == "accounts").alias("n_accounts"), F.count_if(kind == "confirmation-statement").alias("n_confirmation"),
        F.coalesce(F.bool_or((kind == "accounts") & text.contains("dormant")), F.lit(False)).alias("ever_dormant"),
        F.min(F.when(kind == "accounts", F.col("item.date"))).alias("first_accounts_date"), F.min(F.when(kind == "insolvency", F.col("item.date"))).alias("first_insolvency"),
    )


def charges_summary(charges: DataFrame) -> DataFrame:
    paid = F.coalesce(F.col("item.status").contains("satisfied"), F.lit(False))
    return charges.groupBy("entity").agg(F.count("*").alias("charges"), F.count_if(~paid).alias("outstanding"), F.count_if(paid).alias("satisfied"), F.min("item.created_on").alias("first_charge"), F.max("item.created_on").alias("last_charge"))


def archive_members(spark: SparkSession, path: str, wanted: str = r".*") -> DataFrame:
    """archive, member, content of the ZIP members whose name matches; members are read one at a time on the executors."""
    import re

    pattern = re.compile(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.header_offset):
                        if not info.is_dir() and pattern.fullmatch(info.filename):
                            yield pd.DataFrame({"archive": [archive], "member": [info.filename], "content": [z.read(info)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def json_entries(spark: SparkSession, path: str, item: str) -> DataFrame:
    """key, item of a file that holds one JSON object; keys that begin with _ are remarks."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, string>")).alias("key", "raw"))
    return whole.where(~F.col("key").startswith("_")).select("key", F.from_json("raw", item).alias("item"))


def pack(folder: str, archive: str) -> int:
    """Files of a local folder put into a ZIP, which is read back before the folder goes; how many. On a failure the folder stays."""
    root = Path(folder)
    members = sorted(p for p in root.rglob("*") if p.is_file())
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in members:
            z.write(p, p.relative_to(root.parent).as_posix())
    with zipfile.ZipFile(archive) as z:
        if z.testzip() is not None or len(z.infolist()) != len(members):
            raise OSError(f"{archive}: not what {folder} holds; the folder stays")
    shutil.rmtree(root)
    return len(members)


def unpack(archive: str, parent: str) -> int:
    with zipfile.ZipFile(archive) as z:
        z.extractall(parent)
        return len(z.infolist())


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """A folder of CSV files with headers in place of what was there, rows dealt as df has them; nulls are empty fields.

    With ``decimals``, floating-point columns have so many places, as C's %f writes them.
    """
    if decimals is not None:
        fixed = {f.name: F.format_string(f"%.{decimals}f", F.col(f"`{f.name}`")) for f in df.schema if f.dataType.typeName() in {"double", "float"}}
        df = df.withColumns({name: F.when(F.col(f"`{name}`").isNotNull(), c) for name, c in fixed.items()}) if fixed else df
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def whole_number(c: Column) -> Column:
    """The whole number that a text is; 0 for null, empty and other texts."""
    return F.coalesce(F.trim(c).try_cast("bigint"), F.lit(0))


def day_of(c: Column) -> Column:
    """'03-Feb-21', in any case, to a date; null for other texts."""
    return F.try_to_timestamp(F.initcap(F.trim(c)), F.lit("dd-MMM-yy")).cast("date")


def write_partition(df: DataFrame, path: str, column: str, refresh: bool = False) -> None:
    """Appends the partitions that are not there yet; with refresh, replaces those that df has."""
    spark = df.sparkSession
    if refresh:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
        return
    try:
        have = spark.read.parquet(path).select(column).distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.partitionBy(column).parquet(path)
        return
    df.join(have, column, "left_anti").write.mode("append").partitionBy(column).parquet(path)
