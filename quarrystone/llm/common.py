"""What the corpus operators share: table access, checkpoints, hashing and the lists of ids."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The id that stands for a null id inside an operator: larger than all others.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that carry texts to Python workers, by their bytes, unless the session does."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "4m")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where the session names none, a local master (all executors on one machine, as in tests) gets a folder in the warehouse; a cluster gets an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df written to the shared folder, with the way its rows are dealt; its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def released(*frames: DataFrame) -> None:
    """Deletes what saved() or stored() wrote for these frames; nothing may read them any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        plan = df._jdf.queryExecution().analyzed()
        if plan.nodeName() == "LogicalRDD":
            names = [plan.rdd().getCheckpointFile().get()]
        else:
            names = list(df._jdf.inputFiles())
            names = list({n.rpartition("/")[0] for n in names})
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of a wider or clashing table is read."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def chunks_of(batches: Iterable[pa.RecordBatch], limit: int, column: str | int = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([0, *(x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist())])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


@contextmanager
def without_collector() -> Iterator[None]:
    """Python's search for cycles rests while memories that hold none grow, and is afterwards what it was before."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
