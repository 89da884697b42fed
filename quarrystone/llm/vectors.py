"""What the two vector searches share: vectors out of Arrow, query blocks, running lists of the best, and their merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import released, saved, stored

#: Bytes of query vectors that are broadcast at once, whatever the table's size, and queries that ask together.
SENT, TOGETHER = 64_000_000, 4096
#: Lists of a query that are merged into one on a level of the merge tree.
FAN = 32
#: Queries of one number of components: ids, distinct and sorted, and vectors.
Queries = list[tuple[np.ndarray, np.ndarray]]


def matrices(batch: pa.RecordBatch, zeros: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the usable rows of a batch(vec_id, embedding), a matrix for each number of dimensions.

    Not usable: null ids, null or empty vectors, null or non-finite components and, unless zeros, vectors of zeros alone.
    """
    ids, vectors = batch.column(0), batch.column(1)
    lengths = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
    keep = (lengths > 0) & ~ids.is_null().to_numpy(zero_copy_only=False)
    flat = pa.compute.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    at = np.cumsum(lengths) - lengths
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[keep]).tolist():
        rows = np.flatnonzero(keep & (lengths == d))
        x = flat[at[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(1)
        if not zeros:
            good &= (x != 0).any(1)
        if good.any():
            yield ids[rows[good]], x[good]


def usable(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def query_blocks(table: DataFrame, every: int, zeros: bool, sent: int = SENT) -> Iterator[Queries]:
    """The usable vectors whose id is divisible by ``every``, in blocks of about ``sent`` bytes; one of several rows of an id."""
    queries = saved(usable(table).where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    size = queries.agg(F.sum(8 * (F.size("embedding") + 1))).first()[0] or 0
    blocks = max(1, -(-size // sent))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else queries
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in part.toArrow().to_batches():
            for ids, x in matrices(batch, zeros):
                found.setdefault(x.shape[1], []).append((ids, x))
        whole = []
        for parts in found.values():
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids)
            whole.append((ids[order], x[order]))
        yield whole
    released(queries)


class Best:
    """The k best (cost, id) so far of each query, smallest cost first and smaller id at ties. Costs keep their type: integers stay integers."""

    def __init__(self, queries: int, k: int, dtype: type = np.float64):
        self.k = k
        self.query, self.cost, self.id = np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, np.int64)
        self.endless = np.inf if np.dtype(dtype).kind == "f" else np.iinfo(dtype).max
        self.limit = np.full(queries, self.endless, dtype)  # the k-th cost; endless while there are fewer

    def add(self, query: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, c, i = np.concatenate([self.query, query]), np.concatenate([self.cost, cost]), np.concatenate([self.id, ids])
        order = np.lexsort((i, c, q))
        q, c, i = q[order], c[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.limit[q[rank == self.k - 1]] = c[rank == self.k - 1]
        self.query, self.cost, self.id = q[keep], c[keep], i[keep]


#: From the batches of a task, and the queries, the best of each block of queries.
Search = Callable[[Iterator[pa.RecordBatch], Queries], Iterator[tuple[np.ndarray, Best]]]


def searched_by_block(vectors: DataFrame, every: int, k: int, zeros: bool, search: Search, score: str, sign: int) -> DataFrame:
    """query_id, rank, vec_id and score (sign times cost) of the k best of every query: a job for each block of queries, whose broadcast ends with it."""
    spark, whole = vectors.sparkSession, None
    kind = pa.int64() if score == "long" else pa.float64()
    rows = usable(vectors)
    for block in query_blocks(vectors, every, zeros):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for ids, best in search(batches, sent.value):
                n = len(best.query)
                yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(sign * best.cost, kind), pa.array(np.full(n, part, np.int32))], ["query_id", "vec_id", "score", "part"])

        lists = stored(rows.mapInArrow(run, f"query_id long, vec_id long, score {score}, part int"))
        sent.destroy()
        parts = lists.agg(F.max("part")).first()[0]
        found = stored(merged(lists, k, 1 + (parts or 0), F.col("score") * sign))
        released(lists)
        whole = found if whole is None else whole.unionByName(found)
    return whole


def merged(lists: DataFrame, k: int, parts: int, cost: F.Column) -> DataFrame:
    """The first k of each query's lists(query_id, vec_id, score, part), with rank; a tree merges FAN lists of a query on each level."""
    while parts > FAN:
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        best = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(cost, "vec_id"))
        lists, parts = lists.withColumn("rank", best).where(F.col("rank") <= k).drop("rank"), -(-parts // FAN)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(cost, "vec_id"))
    return lists.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
