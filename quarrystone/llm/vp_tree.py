"""Operator 1: approximate nearest neighbours by vantage-point trees, one for each shard.

A node of a tree holds a vantage point, and the range of its distances to the points of either half. By the triangle
inequality a half cannot hold a point nearer than the gap between that range and the query's distance to the vantage
point; it is skipped if ``factor`` times this gap exceeds the distance of the query's k-th best so far. Factor one is exact
search (a gap counts less what rounding may have added to it); larger factors skip halves that would seldom hold a near point. Every row is
indexed; a shard's tree is grown once for a job, and queries go down it together, as blocks.

Scores are Euclidean distances of the original vectors in double precision. Defined results: vectors null, empty, of zeros alone, or
holding null or non-finite components take no part, nor do null ids; vectors meet only those with as many components; a row is no
candidate of a query with its id; repeated candidates count each; of several rows with a query's id the smallest vector asks; ties go to the
smaller vec_id among the points reached; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import table
from quarrystone.llm.vectors import TOGETHER, Best, Queries, matrices, searched_by_block

#: Nearest neighbours of a query; the pruning factor (README has recall and share pruned by factor); points of a shard and of a leaf.
EVERY, K, FACTOR, SHARD, LEAF = 100, 10, 6.5, 16_384, 64
#: A gap is taken for smaller by this share of the distances it comes from: more than their rounding, up to millions of components.
ROUNDING = 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each of x to each of y, by differences, so that equal pairs give equal doubles whatever the block."""
    return np.sqrt(np.square(x[:, None, :] - y[None, :, :]).sum(2))


@dataclass
class Node:
    points: np.ndarray  # of a leaf
    vantage: np.ndarray | None = None
    near: Node | None = None
    far: Node | None = None
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)


def grown(x: np.ndarray, points: np.ndarray, rng: np.random.Generator) -> Node:
    """The tree of the points, the vantage point being that of a few whose distances spread most."""
    if len(points) <= LEAF:
        return Node(points)
    some = rng.choice(points, 5, replace=False)
    sample = rng.choice(points, min(64, len(points)), replace=False)
    vantage = x[some[np.argmax(distances(x[some], x[sample]).std(1))]]
    d = distances(x[points], vantage[None])[:, 0]
    inner = d <= np.median(d)
    if inner.all():  # more than half at one distance
        inner = d < d.max()
        if not inner.any():
            return Node(points)
    a, b = d[inner], d[~inner]
    return Node(points[:0], vantage, grown(x, points[inner], rng), grown(x, points[~inner], rng), (a.min(), a.max()), (b.min(), b.max()))


def planted(x: np.ndarray) -> Node:
    """The tree of a shard; the same for the same points."""
    return grown(x, np.arange(len(x)), np.random.default_rng(len(x)))


def gaps(d: np.ndarray, span: tuple[float, float]) -> np.ndarray:
    return np.maximum(0, np.maximum(span[0] - d, d - span[1]) - ROUNDING * (d + span[1]))


def searched(root: Node, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: Best, factor: float) -> None:
    """Adds to best what the queries find in the tree."""

    def scan(points: np.ndarray, asking: np.ndarray) -> None:
        for at in range(0, len(asking), 256):
            some = asking[at : at + 256]
            d = distances(q[some], x[points])
            row, column = np.nonzero(d <= best.limit[some][:, None])
            query, found = some[row], ids[points[column]]
            other = q_ids[query] != found
            best.add(query[other], d[row, column][other], found[other])

    def home(node: Node, asking: np.ndarray) -> None:
        """Each query's own leaf first, for a limit to prune with."""
        if node.vantage is None:
            scan(node.points, asking)
            return
        d = distances(q[asking], node.vantage[None])[:, 0]
        inner = gaps(d, node.near_range) <= gaps(d, node.far_range)
        for child, some in ((node.near, asking[inner]), (node.far, asking[~inner])):
            if len(some):
                home(child, some)

    def rest(node: Node, asking: np.ndarray, own: np.ndarray) -> None:
        """The other leaves; own: whether the query has come this way before."""
        if node.vantage is None:
            scan(node.points, asking[~own])
            return
        d = distances(q[asking], node.vantage[None])[:, 0]
        a, b = gaps(d, node.near_range), gaps(d, node.far_range)
        inner = a <= b
        for child, gap, came in ((node.near, a, own & inner), (node.far, b, own & ~inner)):
            go = came | (factor * gap <= best.limit[asking])
            if go.any():
                rest(child, asking[go], came[go])

    everyone = np.arange(len(q))
    home(root, everyone)
    rest(root, everyone, np.ones(len(q), bool))


def nearest(vectors: DataFrame, every: int = EVERY, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query; factor one finds the nearest of all."""

    def search(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[tuple[np.ndarray, Best]]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        tops: dict[int, list[tuple[np.ndarray, np.ndarray, Best]]] = {}
        for q_ids, q in queries:
            tops[q.shape[1]] = [(q_ids[at : at + TOGETHER], q[at : at + TOGETHER], Best(len(q_ids[at : at + TOGETHER]), k)) for at in range(0, len(q_ids), TOGETHER)]

        def flush(d: int) -> None:
            parts = held.pop(d)
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            tree = planted(x)
            for q_ids, q, best in tops[d]:
                searched(tree, x, ids, q, q_ids, best, factor)

        for batch in batches:
            for ids, x in matrices(batch, zeros=False):
                d = x.shape[1]
                if d in tops:
                    held.setdefault(d, []).append((ids, x))
                    if sum(len(p[0]) for p in held[d]) >= SHARD:
                        flush(d)
        for d in list(held):
            flush(d)
        for of in tops.values():
            for q_ids, _, best in of:
                yield q_ids, best

    return searched_by_block(vectors, every, k, False, search, "double", 1)


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
