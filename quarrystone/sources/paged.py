"""A paged search service as a Spark data source: queries are refined in the cluster until the service serves each whole, and their pages read to exhaustion in tasks."""

from __future__ import annotations

import heapq
import importlib
import json
import logging
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, int, int], dict]


class RateLimiter:
    """At least ``interval`` seconds between calls of one task."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, float("-inf")

    def wait(self) -> None:
        pause = self.last + self.interval - self.clock()
        if pause > 0:
            self.sleep(pause)
        self.last = self.clock()


def all_items(fetch: Fetch, query: str, size: int = 100, cap: int = 10_000) -> Iterator[dict]:
    """Items of a query, page by page, up to what the service serves; a query that has more is reported."""
    start = 0
    while start < cap:
        page = fetch(query, start, size)
        items = page.get("items") or []
        yield from items
        start += len(items)
        if not items or start >= page.get("hits", 0):
            return
    logging.getLogger(__name__).warning("%s: cut at %s items, slice it finer", query, cap)


def called(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def refined(seeds: DataFrame, splits: list[list[str]], count: str, folder: str, cap: int = 5_000, lanes: int = 8, rate: float = 0.0) -> DataFrame:
    """query, level, hits, cut of the slices that together cover the seeds (query): a query of ``cap`` hits or more gives way to its finer ones.

    Counts are asked in tasks, a round for each level of the splits, and written to ``folder`` as they come in: asking again could give other numbers, and
    a run that broke off goes on with the round that it was in. A slice of the finest level that still reaches the cap is ``cut``.
    """
    spark = seeds.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, lane = called(count), Lane(TaskContext.get().partitionId() % lanes, lanes, rate)
        for pdf in batches:
            hits = []
            for query in pdf["query"]:
                lane.wait()
                hits.append(ask(query))
            yield pdf.assign(hits=hits)

    frontier = seeds.select(F.col("query").cast("string").alias("query")).where("query is not null").distinct()
    for level in range(len(splits) + 1):
        path = f"{folder}/level={level}"
        try:
            found = spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            asked = frontier.repartition(lanes, "query").mapInPandas(counted, "query string, hits long")
            asked.write.mode("overwrite").parquet(path)
            found = spark.read.parquet(path)
        if level == len(splits) or found.where(F.col("hits") >= cap).isEmpty():
            break
        finer = found.where(F.col("hits") >= cap).select("query", F.explode(F.array(*map(F.lit, splits[level]))).alias("part"))
        frontier = finer.select(F.concat_ws("&", "query", "part").alias("query"))
    last = level
    whole = None
    for level in range(last + 1):
        part = spark.read.parquet(f"{folder}/level={level}").select("query", F.lit(level).alias("level"), "hits", (F.col("hits") >= cap).alias("cut"))
        part = part if level == last else part.where(~F.col("cut"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


class Lane:
    """Calls of one of several tasks that together keep to ``rate`` calls a second: lane i of n has every n-th slot of the clock, and no lane another's."""

    def __init__(self, i: int, n: int, rate: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.period, self.phase = (n / rate, i / rate) if rate else (0.0, 0.0)
        self.clock, self.sleep, self.next = clock, sleep, float("-inf")

    def wait(self) -> None:
        if not self.period:
            return
        now = self.clock()
        slot = max(math.ceil((now - self.phase) / self.period) * self.period + self.phase, self.next)
        self.next = slot + self.period
        if slot > now:
            self.sleep(slot - now)


def dealt(slices: list[tuple[str, int]], lanes: int) -> list[list[str]]:
    """The queries in at most ``lanes`` lists of about equal hits, the largest dealt first."""
    heap: list[tuple[int, int, list[str]]] = [(0, i, []) for i in range(min(lanes, len(slices)))]
    for query, hits in sorted(slices, key=lambda s: (-s[1], s[0])):
        n, i, held = heapq.heappop(heap)
        held.append(query)
        heapq.heappush(heap, (n + hits + 1, i, held))
    return [held for _, i, held in sorted(heap, key=lambda x: x[1])]


@dataclass
class Queries(InputPartition):
    """What one task asks for, in its lane."""

    queries: list[str]
    lane: int
    lanes: int


class PagedSource(DataSource):
    """format("paged"): the items of slices, a task for each lane.

    Options: ``service`` (module:function of query, start, size), ``slices`` (JSON list of queries) or ``slices_at`` (folder of a table with query and hits, as
    refined() leaves it), ``lanes`` (tasks; as many as slices without it), ``rate`` (calls a second of all tasks together), ``size``, ``cap``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "slice string, item string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        if "slices_at" in self.options:
            import pyarrow.dataset as ds
            from pyarrow import fs

            at = self.options["slices_at"]
            files, root = fs.FileSystem.from_uri(at) if at.startswith("file:") or "://" in at else (fs.LocalFileSystem(), at)
            rows = ds.dataset(root, filesystem=files, format="parquet", exclude_invalid_files=False).to_table(columns=["query", "hits"])
            slices = list(zip(*(rows.column(c).to_pylist() for c in ("query", "hits"))))
        else:
            slices = [(q, 1) for q in json.loads(self.options["slices"])]
        lanes = dealt(slices, int(self.options.get("lanes", max(1, len(slices)))))
        return [Queries(held, i, len(lanes)) for i, held in enumerate(lanes)]

    def read(self, partition):
        fetch = called(self.options["service"])
        lane = Lane(partition.lane, partition.lanes, float(self.options.get("rate", 0)))

        def limited(query: str, start: int, size: int) -> dict:
            lane.wait()
            return fetch(query, start, size)

        for query in partition.queries:
            for item in all_items(limited, query, int(self.options.get("size", 100)), int(self.options.get("cap", 10_000))):
                yield query, json.dumps(item, sort_keys=True)
