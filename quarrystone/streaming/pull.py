"""A resumable pull of many (entity, endpoint) pairs from a service, as a streaming source.

The targets are a folder of numbered rounds, each written once by ``enlist`` from a table, in slices. The offset is the number of rounds planned, so a query
that ran to its end asks only for later rounds. Inside a batch, a task that reads a slice keeps the answers in files of a few pairs as it goes; a
batch that was killed and is run again reads these and asks for the rest. A pair that the service refuses, or that patience gives up, is a row with ``error``, so that
one entity never ends a run; ``retry`` enlists those again. What is committed needs no kept answers: commit() deletes them.

    enlist(targets, folder)                                          # entity, endpoint
    spark.dataSource.register(PullSource)
    rows = spark.readStream.format("pull").options(folder=folder, service="module:function").load()
    rows.writeStream.trigger(availableNow=True).option("checkpointLocation", ...)...
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarrystone.sources.paged import RateLimiter
from quarrystone.sources.patience import Refused, Unanswered

#: Pairs of a slice, which one task asks for; pairs whose answers are kept at once.
SLICE, EVERY = 500, 50
SCHEMA = "round int, entity string, endpoint string, items int, answer string, error string"


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def rounds(folder: str) -> int:
    """Rounds that were written to their end."""
    files, root = store(folder)
    found = files.get_file_info(fs.FileSelector(f"{root}/targets", allow_not_found=True))
    done = {int(m[1]) for f in found if (m := re.fullmatch(r"round=(\d+)", f.base_name)) and files.get_file_info(f"{f.path}/_SUCCESS").type != fs.FileType.NotFound}
    n = 0
    while n in done:
        n += 1
    return n


def enlist(targets: DataFrame, folder: str, slice_: int = SLICE) -> int:
    """Writes the pairs (entity, endpoint) that no round has yet as the next round; how many rounds there are.

    The pairs are dealt into slices by their hash, so a slice holds about ``slice_`` of them whatever their order.
    """
    spark = targets.sparkSession
    pairs = targets.select(F.col("entity").cast("string"), F.col("endpoint").cast("string")).where("entity is not null and endpoint is not null").distinct()
    have = rounds(folder)
    if have:
        pairs = pairs.join(spark.read.schema("entity string, endpoint string, again boolean").json(f"{folder}/targets").select("entity", "endpoint"), ["entity", "endpoint"], "left_anti")
    return listed(pairs.withColumn("again", F.lit(False)), folder, have, slice_)


def retry(rows: DataFrame, folder: str, slice_: int = SLICE) -> int:
    """Enlists again the pairs that these rows of the pull have only errors of."""
    failed = rows.groupBy("entity", "endpoint").agg(F.bool_and(F.col("error").isNotNull()).alias("failed")).where("failed").select("entity", "endpoint")
    return listed(failed.withColumn("again", F.lit(True)), folder, rounds(folder), slice_)


def listed(pairs: DataFrame, folder: str, have: int, slice_: int) -> int:
    pairs = pairs.persist()
    n = pairs.count()
    if n:
        pairs.repartition(-(-n // slice_), "entity", "endpoint").sortWithinPartitions("entity", "endpoint").write.mode("overwrite").json(f"{folder}/targets/round={have}")
    pairs.unpersist()
    return have + (n > 0)


@dataclass
class Slice(InputPartition):
    round: int
    path: str


class PullReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)
        self.folder = self.options["folder"]

    def initialOffset(self) -> dict:
        return {"rounds": 0}

    def latestOffset(self) -> dict:
        return {"rounds": rounds(self.folder)}

    def partitions(self, start: dict, end: dict):
        files, root = store(self.folder)
        return [
            Slice(n, f.path)
            for n in range(start["rounds"], end["rounds"])
            for f in sorted(files.get_file_info(fs.FileSelector(f"{root}/targets/round={n}")), key=lambda f: f.path)
            if f.base_name.startswith("part-") and f.size
        ]

    def read(self, partition: Slice) -> Iterator[tuple]:
        files, root = store(self.folder)
        with files.open_input_stream(partition.path) as f:
            pairs = [json.loads(line) for line in f.read().decode().splitlines()]
        kept = f"{root}/kept/{partition.round}/{partition.path.rpartition('/')[2]}"
        module, _, function = self.options["service"].partition(":")
        ask = getattr(importlib.import_module(module), function)
        limiter = RateLimiter(float(self.options.get("interval", 0)))
        every = int(self.options.get("every", EVERY))
        for at in range(0, len(pairs), every):
            place = f"{kept}/{at}.json"
            if files.get_file_info(place).type == fs.FileType.NotFound:
                rows = [asked(ask, limiter, p["entity"], p["endpoint"]) for p in pairs[at : at + every]]
                put(files, place, json.dumps(rows).encode())
            else:
                with files.open_input_stream(place) as f:
                    rows = json.loads(f.read())
            for row in rows:
                yield (partition.round, *row)

    def commit(self, end: dict) -> None:
        files, root = store(self.folder)
        for f in files.get_file_info(fs.FileSelector(f"{root}/kept", allow_not_found=True)):
            if f.base_name.isdigit() and int(f.base_name) < end["rounds"]:
                files.delete_dir(f.path)


def asked(ask: Callable[[str, str], object], limiter: RateLimiter, entity: str, endpoint: str) -> tuple:
    """The row of a pair: its answer with the number of its items, or the error that it ended in. A bug is no answer, and ends the task."""
    limiter.wait()
    try:
        answer = ask(entity, endpoint)
    except (Refused, Unanswered, OSError) as e:
        return entity, endpoint, None, None, f"{type(e).__name__}: {e}"
    return entity, endpoint, len(answer) if isinstance(answer, list) else int(answer is not None), json.dumps(answer, sort_keys=True), None


def put(files: fs.FileSystem, place: str, content: bytes) -> None:
    """The file appears whole or not at all; another attempt of the task may have put it already."""
    import uuid

    files.create_dir(place.rpartition("/")[0])
    part = f"{place}.{uuid.uuid4()}.part"
    with files.open_output_stream(part) as f:
        f.write(content)
    files.move(part, place)


class PullSource(DataSource):
    """format("pull"): options ``folder``, ``service`` (module:function of entity and endpoint), ``interval`` in seconds between a task's calls, ``every``."""

    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PullReader(self.options)


def progress(rows: DataFrame) -> DataFrame:
    """entity, endpoint, items of the pairs pulled so far, each once: the latest answer counts."""
    return rows.where("error is null").groupBy("entity", "endpoint").agg(F.max_by("items", "round").alias("items"))


def histories(rows: DataFrame, endpoint: str, item: str) -> DataFrame:
    """entity, position, item of the answers of an endpoint, as a folder of histories gives them."""
    answers = rows.where((F.col("endpoint") == endpoint) & F.col("error").isNull()).groupBy("entity").agg(F.max_by("answer", "round").alias("answer"))
    return answers.select("entity", F.posexplode(F.from_json("answer", item)).alias("position", "item"))
