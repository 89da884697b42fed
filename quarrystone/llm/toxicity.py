"""Operator 10: toxicity by a factorization machine over hashed terms.

A document is the set of its terms (runs of letters, lower-cased), each hashed to a slot. The machine scores
``w0 + sum of w[i] + sum over pairs of <v[i], v[j]>``: the last part learns what pairs of terms say together (an insult
and the mention of a group), which a sum of single weights cannot. It is fitted on at most ``SAMPLE`` labelled documents,
those with the smallest hash of the id, on the ``ACTIVE`` slots that differ most between the two labels by chi-square;
scoring reads every whole text.

Defined results: a null or empty text, or one without known terms, scores by the constant alone; without usable labels
the constant is that of one toxic document in three; labels that are null or of a null id teach nothing, and repeated
labels of a document count once, toxic if any is; a null id is not held out; repeated rows score alike; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import chunks_of, id_and_text, table, text_batches

#: Labelled documents to fit on, at most: the documented bound of the sample.
SAMPLE = 8_000
#: Steps to fit, at least: a small sample is passed over more often.
STEPS = 300
#: Slots of the hash; slots that carry weights, and the chi-square that they have at least; factors of a slot; passes over the sample.
SLOTS, ACTIVE, CHI, FACTORS, PASSES = 1 << 20, 4096, 10.0, 8, 12
TERM = re.compile(r"[^\W\d_]+")


def slots(text: str) -> set[int]:
    return {zlib.crc32(t.encode("utf-8", "surrogatepass")) & (SLOTS - 1) for t in set(TERM.findall(text.lower()))}


class Machine:
    """w0, and for each active slot a weight and factors."""

    def __init__(self, w0: float, active: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.w0, self.active, self.w, self.v = w0, active, w, v
        self.place = {int(s): i for i, s in enumerate(active)}

    @classmethod
    def fit(cls, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
        """flat: the slots of all documents, one document's behind the other's; sizes: how many each has."""
        y = labels.astype(np.float64)
        w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 2)))
        if not len(y) or y.min() == y.max():
            return cls(w0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        n1, n = y.sum(), len(y)
        seen, seen1 = np.bincount(flat, minlength=SLOTS), np.bincount(flat[(y > 0)[owner]], minlength=SLOTS)
        expected = seen * n1 / n
        with np.errstate(divide="ignore", invalid="ignore"):
            chi = np.nan_to_num((seen1 - expected) ** 2 * n / (expected * (n - n1) * (1 - seen / n) + 1e-9))
        chi[seen < 3] = 0
        active = np.sort(np.argsort(-chi, kind="stable")[:ACTIVE])
        active = active[chi[active] > CHI]
        of = np.full(SLOTS, -1, np.int32)
        of[active] = np.arange(len(active))
        keep = of[flat] >= 0
        flat, owner = of[flat[keep]], owner[keep]
        first = np.searchsorted(owner, np.arange(len(sizes) + 1))
        rng = np.random.default_rng(seed)
        w, v = np.zeros(len(active)), rng.normal(0, 0.01, (len(active), FACTORS))
        gw, gv, g0 = np.full(len(active), 1e-6), np.full(v.shape, 1e-6), 1e-6
        for _ in range(max(PASSES, STEPS // -(-n // 128))):
            order = rng.permutation(n)
            for at in range(0, n, 128):
                part = order[at : at + 128]
                spans = [flat[first[d] : first[d + 1]] for d in part]
                ids, doc = np.concatenate(spans), np.repeat(np.arange(len(part)), [len(s) for s in spans])
                vi = v[ids]
                sums = np.stack([np.bincount(doc, vi[:, f], len(part)) for f in range(FACTORS)], 1)
                squares = np.bincount(doc, (vi**2).sum(1), len(part))
                z = w0 + np.bincount(doc, w[ids], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
                used, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, error[doc]) / len(part) + 2e-5 * w[used]
                dv = np.stack([np.bincount(back, error[doc] * (sums[doc, f] - vi[:, f])) for f in range(FACTORS)], 1) / len(part) + 1e-4 * v[used]
                d0 = error.mean()
                gw[used] += dw**2
                gv[used] += dv**2
                g0 += d0**2
                w[used] -= 0.5 * dw / np.sqrt(gw[used])
                v[used] -= 0.05 * dv / np.sqrt(gv[used])
                w0 -= 0.05 * d0 / np.sqrt(g0)
        return cls(float(w0), active, w, v)

    def score(self, found: set[int]) -> float:
        at = sorted(self.place[s] for s in found if s in self.place)
        v = self.v[at]
        z = self.w0 + self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine fitted on at most ``sample`` labelled documents that are not held out; the same for the same rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_of(batches, 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([sorted(slots(t or "")) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "toxic", "slots"])

    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id long, toxic int, slots array<int>").toArrow()
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable"))).combine_chunks()
    if not rows.num_rows:
        return Machine.fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
    lists = rows.column("slots").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    machine = Machine.fit(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), rows.column("toxic").to_numpy())
    del rows, lists
    pa.default_memory_pool().release_unused()
    return machine


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    machine = fitted(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_of(batches, 2_000_000):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([machine.score(slots(t or "")) for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    out = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the machine does not reject, with all their columns as they are."""
    machine = fitted(docs, labels, sample)
    at = docs.columns.index("text")
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_of(batches, 2_000_000, at):
            yield b.filter(pa.array([machine.score(slots(t or "")) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
