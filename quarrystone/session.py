"""Session builder and the checks and sinks that every step shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def session(name: str = "quarrystone", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ANSI stays on, as Spark has it."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, or an error that names a repeated key."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated key {twice[0].asDict()}")
    return df


def replace_table(df: DataFrame, path: str, schema: StructType, partition_by: list[str] | None = None) -> None:
    """Writes df under exactly this schema in place of what was there."""
    typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    writer = typed.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_flow(df: DataFrame, path: str) -> None:
    """Adds audit rows (step, stage, n, note); a step that is written again replaces its own rows alone."""
    (
        df.select(F.col("step").cast("string"), F.col("stage").cast("string"), F.col("n").cast("long"), F.col("note").cast("string"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(path)
    )


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def optional_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one of this schema where there is none: steps that only add to a result need no other branch."""
    files, at = _place(spark, path)
    return spark.read.parquet(path) if files.exists(at) else spark.createDataFrame([], schema)


def with_columns_of(df: DataFrame, *columns: StructField) -> DataFrame:
    """df with the columns that it lacks, as nulls of their types."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in columns if f.name not in df.columns})


def renamed(spark: SparkSession, path: str, names: dict[str, str], schema: StructType) -> None:
    """Gives columns of the table at ``path`` new names, in place: the table is written beside it under ``schema`` (the new names) and then takes its place.

    A name that is already new is left, so the step may run again; a name that is neither is an error.
    """
    have = spark.read.parquet(path)
    unknown = [old for old, new in names.items() if old not in have.columns and new not in have.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    fresh = {old: new for old, new in names.items() if old in have.columns}
    if not fresh:
        return
    beside = f"{path}.renamed"
    replace_table(have.withColumnsRenamed(fresh), beside, schema)
    files, at = _place(spark, path)
    files.delete(at, True)
    if not files.rename(_place(spark, beside)[1], at):
        raise OSError(f"{beside} could not take the place of {path}")


def reset(spark: SparkSession, path: str) -> bool:
    """Removes the tables under the path; whether there was something."""
    files, at = _place(spark, path)
    return files.delete(at, True)
