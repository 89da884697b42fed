"""Operator 4: exact top-k search by tiled matrix products.

A block of queries, of bounded size, meets each shard of the table in tiles of a few thousand rows: one matrix product gives the
tile's scores, only those that reach a query's k-th best so far are looked at, and each task leaves k rows a query. These
lists are merged in a tree.

Components are turned into floor(256 * x) and the score is their integer inner product. It is computed in doubles where these hold it
exactly, in 64-bit integers where these do, and in integers of any size else; it is kept as a 64-bit integer throughout. Defined results: a
score beyond 2**63 - 2 either way is returned, and ranked, as that number; vectors null, empty, or holding null or non-finite components take no
part, nor do null ids; vectors meet only those with as many components; a row is no candidate of a query with its id; repeated candidates count
each; of several rows with a query's id the smallest vector asks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import table
from quarrystone.llm.vectors import TOGETHER, Best, Queries, matrices, searched_by_block

EVERY, K, SCALE, TILE = 50, 5, 256, 4096
#: The largest score either way; a cost beyond it says that there is none.
MOST = 2**63 - 2


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in integers of any size; doubles from 2**53 on are integers already."""
    return np.asarray([int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()], object).reshape(x.shape)


def product(q: np.ndarray, x: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of floor(scale * q) and floor(scale * x), exact up to MOST either way, as 64-bit integers."""
    high = (float(np.abs(q).max()) * scale + 1) * (float(np.abs(x).max()) * scale + 1) * q.shape[1]
    if high < 2**53:
        return (np.floor(scale * q) @ np.floor(scale * x).T).astype(np.int64)
    if high < 2**62:  # the bound itself is rounded
        return np.floor(scale * q).astype(np.int64) @ np.floor(scale * x).astype(np.int64).T
    return np.clip(whole(q, scale) @ whole(x, scale).T, -MOST, MOST).astype(np.int64)


def exact_topk(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products of every query."""

    def search(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[np.ndarray, Best]]:
        tops = [(ids[at : at + TOGETHER], q[at : at + TOGETHER], Best(len(ids[at : at + TOGETHER]), k, np.int64)) for ids, q in queries for at in range(0, len(ids), TOGETHER)]
        for batch in batches:
            for ids, x in matrices(batch, zeros=True):
                for q_ids, q, top in tops:
                    if q.shape[1] != x.shape[1]:
                        continue
                    for at in range(0, len(ids), TILE):
                        tile_ids = ids[at : at + TILE]
                        cost = -product(q, x[at : at + TILE], scale)
                        mine = np.minimum(np.searchsorted(q_ids, tile_ids), len(q_ids) - 1)  # query ids are distinct and sorted
                        own = np.flatnonzero(q_ids[mine] == tile_ids)
                        cost[mine[own], own] = top.endless
                        reach = top.limit
                        if (reach == top.endless).any() and cost.shape[1] > k:
                            reach = np.minimum(reach, np.partition(cost, k - 1, axis=1)[:, k - 1])
                        row, column = np.nonzero(cost <= reach[:, None])
                        other = q_ids[row] != tile_ids[column]
                        row, column = row[other], column[other]
                        top.add(row, cost[row, column], tile_ids[column])
        for q_ids, _, top in tops:
            yield q_ids, top

    return searched_by_block(vectors, every, k, True, search, "long", -1)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
