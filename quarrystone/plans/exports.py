"""The result tables as files: one folder of CSV for each, those of steps that have not run left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.plans.registry import QUERIES
from quarrystone.sources.files import write_csv

#: File names by query, in the order in which they are written.
TABLES = {
    "openings_by_year_format": "Q60_openings_by_year_format", "openings_by_year_segment": "Q61_openings_by_year_segment", "openings_by_nation_era": "Q62_openings_by_nation_era", "closures_by_year_format": "Q63_closures_by_year_format",
    "closures_by_nation_era": "Q64_closures_by_nation_era", "outcomes_by_format": "Q65_outcomes_by_format", "outcomes_by_nation": "Q66_outcomes_by_nation", "lifespan_summary": "Q67_lifespan_summary", "lifespan_buckets": "Q68_lifespan_buckets",
    "net_churn": "Q69_net_churn", "succession_matrix": "Q70_succession_matrix", "succession_by_user_group": "Q71_succession_by_user_group", "succession_gaps": "Q72_succession_gaps", "successor_industries": "Q73_successor_industries",
    "top_keys": "Q74_top_keys", "cohort_by_nation": "Q75_cohort_by_nation", "flow": "Q76_flow_sorted", "routes_by_format": "Q77_routes_by_format", "routes_by_era": "Q78_routes_by_era",
}
#: What a table needs beside the cohort's own.
NEEDS = {name: "events" for name in ("succession_matrix", "succession_by_user_group", "succession_gaps", "successor_industries", "routes_by_format", "routes_by_era")}


def ordered(df: DataFrame) -> DataFrame:
    """In one file and in one order, as result tables are small: a row for each group."""
    return df.coalesce(1).sortWithinPartitions(*df.columns)


def write_tables(spark: SparkSession, sf_dir: str, folder: str, decimals: int | None = None) -> dict[str, int | None]:
    """Writes every table under ``folder``; rows by name, None for those that need a table that is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(sf_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, int | None] = {}
    for name, query in TABLES.items():
        if name in NEEDS and not files.exists(at(f"{sf_dir}/{NEEDS[name]}.parquet")):
            out[name] = None
            continue
        write_csv(ordered(QUERIES[query](spark, sf_dir)), f"{folder}/{name}", decimals)
        out[name] = spark.read.option("header", True).csv(f"{folder}/{name}").count()
    return out
