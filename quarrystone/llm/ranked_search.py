"""Operator 12: ranked lexical search, score at a time over impact-ordered postings.

One pass over the documents counts the queries' terms in each whole text; the sums of its rows are the corpus statistics, from which
every posting gets an exact integer impact. A second pass scores shards of documents. A shard holds, for each term, its postings by falling
impact; a query takes whole groups of equal impact, the highest first over all its terms, into one accumulator a document. It stops when the
documents whose sum so far plus the highest impacts left could still reach the k-th best are few; these alone are completed, from
the shard's rows, and so their scores are exact. The k-th best of a task's earlier shards bounds its later ones. Tasks leave k rows a query, which a tree merges.

Terms, weights and scores are those of ``op12`` in whole numbers, but for the one logarithm of a weight. Defined results: null and empty texts, and
those without terms, are in no count; a null id is a document like others, comes after all ids at equal scores and is returned as null; rows
that share an id are documents of their own; rows of one item id (null is one) make one item with all their terms, one without terms has no rows; a term that
no document holds adds nothing; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import NO_ID, chunks_of, id_and_text, released, saved, stored, table, text_batches
from quarrystone.llm.vectors import SENT, Best, merged

K = 50
#: Documents and postings of a shard, at most (a single document may have more); documents that a query completes at once.
DOCUMENTS, POSTINGS, FEW = 32_768, 4_000_000, 1024
#: ASCII but digits and letters parts terms; A-Z is lower-cased, and every byte from 0x80 on belongs to a character that is kept.
PARTED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PARTED).split()


def items_of(items: DataFrame) -> DataFrame:
    """item_id and the distinct terms of each item."""
    text_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = sorted(set(terms(text)))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(part), pa.int64()), pa.array(part, pa.binary())], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "item_id long, term binary").distinct()


def blocks_of(items: DataFrame, sent: int = SENT) -> Iterator[tuple[list[int | None], list[np.ndarray], list[bytes]]]:
    """(item ids, numbers of their terms, terms by number) in blocks of about ``sent`` bytes, whatever the table's size."""
    pairs = saved(items_of(items))
    size = pairs.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    blocks = -(-size // sent)
    for b in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else pairs
        number: dict[bytes, int] = {}
        of: dict[int | None, list[int]] = {}
        for batch in part.toArrow().to_batches():
            for ident, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.setdefault(ident, []).append(number.setdefault(term, len(number)))
        yield list(of), [np.asarray(x, np.int64) for x in of.values()], list(number)
    released(pairs)


def counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the numbers and counts of the queries' terms of every document that has terms."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in chunks_of(batches, 4_000_000):
            ids, sizes, found, times, ends = [], [], [], [], [0]
            for ident, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                tf = Counter(words)
                mine = tf.keys() & known.keys()
                ids.append(ident)
                sizes.append(len(words))
                found.extend(map(known.__getitem__, mine))
                times.extend(map(tf.__getitem__, mine))
                ends.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int64()))],
                ["doc_id", "n", "terms", "times"],
            )

    rows = id_and_text(docs).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Postings of some documents by term, those of the highest impact first, and the same by document."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray):
        self.ids, self.terms = ids, terms
        owner = np.repeat(np.arange(len(ids)), sizes)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * m[owner]))
        order = np.lexsort((-self.impact, terms))
        self.falling, self.owner = self.impact[order], owner[order]
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def best(self, wanted: np.ndarray, k: int, reach: int, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores, the k best among them, of the query of these terms; what scores less than ``reach`` may be left out."""
        at, end = self.first[wanted].tolist(), self.first[wanted + 1].tolist()
        falling, owner = self.falling, self.owner
        sums = np.zeros(len(self.ids), np.int64)
        while True:
            left = [int(falling[a]) if a < e else 0 for a, e in zip(at, end)]
            rest = sum(left)
            kth = int(np.partition(sums, len(sums) - k)[len(sums) - k]) if len(sums) > k else 0
            # sums only grow, so the k-th of them is a bound from below; no document gains more than rest
            could = np.flatnonzero(sums + rest >= max(kth, reach, 1))
            if not rest or len(could) <= few:
                break
            level = max(left) // 2
            for i, high in enumerate(left):
                if high > level:
                    to = at[i] + int(np.searchsorted(-falling[at[i] : end[i]], -level, side="left"))  # whole groups of equal impact
                    sums[owner[at[i] : to]] += falling[at[i] : to]  # a document has one posting a term
                    at[i] = to
        scores = sums[could]
        if rest and len(could):
            scores = self.completed(could, wanted)
        keep = scores > 0
        return could[keep], scores[keep]

    def completed(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The whole scores of these documents."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        which = np.repeat(np.arange(len(docs)), sizes)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[docs][which]
        asked = np.zeros(len(self.first), bool)
        asked[wanted] = True
        mine = asked[self.terms[rows]]
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, which[mine], self.impact[rows[mine]])
        return out


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, total: int) -> Iterator[Shard]:
    """The rows of counted(), in shards of bounded size."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = postings = 0

    def made() -> Shard:
        ids, n, sizes, found, times = (np.concatenate(x) for x in zip(*held))
        m = np.asarray([50 + 50 * x * documents // total for x in n.tolist()], np.int64) if len(n) and 50 * int(n.max()) * documents >= 2**63 else 50 + 50 * n * documents // total
        return Shard(ids, m, sizes, found, times, weights)

    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            found, times = part.column("terms"), part.column("times")
            sizes = pa.compute.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
            if rows and (rows + part.num_rows > DOCUMENTS or postings + int(sizes.sum()) > POSTINGS):
                yield made()
                held, rows, postings = [], 0, 0
            held.append((part.column("doc_id").fill_null(NO_ID).to_numpy(), part.column("n").to_numpy(), sizes, found.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy()))
            rows, postings = rows + part.num_rows, postings + int(sizes.sum())
    if rows:
        yield made()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of every item: two jobs for each block of items, one block in all but vast tables."""
    sc, whole = docs.sparkSession.sparkContext, None
    for idents, wanted, vocabulary in blocks_of(items):
        rows = stored(counted(docs, {t: i for i, t in enumerate(vocabulary)}))
        documents, total = rows.agg(F.count("*"), F.sum("n")).first()
        holding = np.zeros(len(vocabulary), np.int64)
        for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
            holding[term] = n
        weights = np.asarray([weight(documents, int(h)) for h in holding], np.int64)
        sent = sc.broadcast((idents, wanted, weights))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, documents=documents, total=total) -> Iterator[pa.RecordBatch]:
            idents, wanted, weights = sent.value
            best = Best(len(wanted), k, np.int64)
            for shard in shards(batches, weights, documents, total):
                found = []
                for i, mine in enumerate(wanted):
                    reach = 0 if best.limit[i] == best.endless else -int(best.limit[i])
                    at, scores = shard.best(mine, k, reach)
                    found.append((np.full(len(at), i), -scores, shard.ids[at]))
                best.add(*(np.concatenate(x) for x in zip(*found)))
            n, part = len(best.query), TaskContext.get().partitionId()
            ids = pa.array([idents[i] for i in best.query.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.id), pa.array(-best.cost, pa.int64()), pa.array(np.full(n, part, np.int32))], ["query_id", "vec_id", "score", "part"])

        lists = stored(rows.mapInArrow(run, "query_id long, vec_id long, score long, part int"))
        sent.destroy()
        parts = lists.agg(F.max("part")).first()[0]
        found = stored(merged(lists, k, 1 + (parts or 0), -F.col("score")))
        released(rows, lists)
        whole = found if whole is None else whole.unionByName(found)
    if whole is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return whole.select(F.col("query_id").alias("item_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("doc_id"), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
t as (select k, term, count(*) as tf from (select k, unnest(words) as term from d) group by all),
c as (select count(*) as docs, cast(sum(len(words)) as bigint) as total from d where len(words) > 0),
f as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from t cross join c group by term),
i as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
m as (select k, doc_id, 50 + (50 * len(words) * docs) // total as m from d cross join c where len(words) > 0),
s as (
  select item_id, m.k, m.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
  from i join t using (term) join f using (term) join m on m.k = t.k group by all
), r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 50
"""
