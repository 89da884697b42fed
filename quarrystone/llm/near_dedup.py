"""Operator 5: near-duplicates by MinHash, sketched in rounds, banded, and verified on the full sets.

A document is the set of its distinct shingles of ``size`` words. *Fast similarity sketching*: in round i each element goes to a
bin chosen by a hash of the round, with a value that grows with the round, and a bin keeps its smallest value; the rounds end
when every bin is filled, and the last ``BINS`` rounds fill one given bin each, so that every bin is sure to fill. Two sketches
agree in a bin with the probability of the sets' similarity, concentrated as for independent bins, at the cost of the set plus
``BINS log BINS`` instead of their product.

Sketches are cut into ``BANDS`` bands of ``ROWS``; sets that agree in a band are candidates. At similarity 0.8 a pair is in no bucket together
with probability (1 - 0.8**5)**40 = 1e-7: this is the only way to lose a link. Texts of the same words are one node from the start
(the SHA-256 of the words joined by a space). Every node is first compared with the smallest nodes of its buckets that it shares most bands
with; these links are verified and joined to components. Then all nodes of buckets that still hold several components are
compared wherever the prefix filter on their rarest shingles says that they can be similar, so that no candidate which could join two
components is left out, while a large group of copies of one text, linked already, never expands into pairs.

Hashes propose, words decide: links are confirmed on sets whose shingles are compared word by word, and a set's size counts shingles that
differ as words.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, A-Z lower-cased. Defined results: null and empty texts, or
texts of blanks, have no shingles and link with nothing; a text with fewer words than a shingle is one shingle; rows that share
an id are one document, linked as any of its texts is; rows with a null id take no part and are kept; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import chunks_of, id_and_text, mix64, released, saved, stored, table
from quarrystone.llm.components import components

SHINGLE, SIMILAR = 5, 80
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Slots in which shingles are counted for the order of rarity: so much is broadcast, whatever the input. The order decides costs alone.
SLOTS = 1 << 20
#: Words that a worker remembers.
REMEMBERED = 100_000
U = np.uint64


class Numbers(dict):
    """Numbers of words, as they are met, and a name of 64 bits for each, which is the same in every worker."""

    def __init__(self) -> None:
        self.names = array("Q")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.names)
        self.names.append(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
        return n


_numbers = Numbers()


def forget() -> None:
    """At a task's end: the worker lives on, its words do not."""
    global _numbers
    _numbers = Numbers()
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> list[list[bytes]]:
    """bytes.split and bytes.lower know the six blanks and A-Z alone."""
    return [(t or b"").lower().split() for t in texts.cast(pa.large_binary()).to_pylist()]


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(size)))) or ({tuple(words)} if words else set())


def named(words: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the shingles of all texts, one text's behind the other's, repeated ones too, and which text's each is. Names are hashes, the same everywhere."""
    global _numbers
    if len(_numbers) > REMEMBERED:
        _numbers = Numbers()
    units = np.cumsum([0, *map(len, words)])
    ids = np.fromiter(map(_numbers.__getitem__, chain.from_iterable(words)), np.int64, int(units[-1]))
    of = np.frombuffer(_numbers.names.tobytes(), U)[ids]
    doc = np.repeat(np.arange(len(words)), np.diff(units))
    at = np.arange(len(ids))
    last, first = units[1:][doc], units[:-1][doc]
    use = (at + size <= last) | (at == first)
    at, doc, end = at[use], doc[use], np.minimum(at[use] + size, last[use])
    name = (end - at).astype(U)
    for k in range(size):
        name = np.where(at + k < end, mix64(name * U(0x9FB21C651E98DF25) + of[np.minimum(at + k, len(of) - 1)]), name)
    return name, doc


def shingle_sets(words: list[list[bytes]], size: int, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the distinct shingles of all texts, by text, rarest first (often: a class of frequency for each slot), and where each text's begin.

    Sizes are those of the sets of words themselves: should two shingles of a text ever share a name, it counts twice.
    """
    name, doc = named(words, size)
    rarity = np.zeros(len(name), U) if often is None else often[(name & U(SLOTS - 1)).astype(np.int64)].astype(U)
    for_doc = max(1, len(words).bit_length())
    short = doc.astype(U) << U(64 - for_doc) | rarity << U(58 - for_doc) | name >> U(for_doc + 6)
    order = np.argsort(short, kind="stable")
    doc, name, short = doc[order], name[order], short[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    if (new[1:] & (short[1:] == short[:-1])).any():  # names that differ in their last bits alone may lie mixed
        order = np.lexsort((name, short))
        doc, name = doc[order], name[order]
        new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
    doc, name = doc[new], name[new]
    return name, np.searchsorted(doc, np.arange(len(words) + 1))


def sketches(names: np.ndarray, cuts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """A row of bins for each set that is not empty (rows of empty sets mean nothing)."""
    sets = len(cuts) - 1
    full = np.iinfo(U).max
    out = np.full(sets * bins, full, U)
    doc = np.repeat(np.arange(sets), np.diff(cuts))
    low = U(0xFFFFFFFF)
    for number in range(2 * bins):
        h = mix64(names + U((number * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        value = U(number << 32) | (h & low)
        bin_ = ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64) if number < bins else number - bins
        np.minimum.at(out, doc * bins + bin_, value)
        if number < 4 or number % 8 == 0:
            open_ = (out.reshape(sets, bins) == full).any(1)
            stay = open_[doc]
            if not stay.all():
                names, doc = names[stay], doc[stay]
            if not len(names):
                break
    return out.reshape(sets, bins)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketch.reshape(len(sketch), bands, -1)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U)), rows.shape[:2])
    for i in range(rows.shape[2]):
        key = mix64(key * U(0x9FB21C651E98DF25) + rows[:, :, i])
    return key.view(np.int64)


def lists_of(names: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(names.view(np.int64)))


def sketched(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n (shingles), same (names the text's words), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks_of(batches, 2_000_000):
            words = words_of(b.column("text"))
            names, cuts = shingle_sets(words, size)
            n = np.diff(cuts)
            keys = band_keys(sketches(names, cuts, bands * ROWS), bands)
            some = n > 0
            n = np.asarray([x if x == len(w) - size + 1 or x < 2 else len(shingles(w, size)) for x, w in zip(n.tolist(), words)], np.int64)  # the words' own count
            same = [hashlib.sha256(b" ".join(w)).digest() for w in words]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(same, pa.binary()), lists_of(keys[some].ravel(), some * bands)], ["doc_id", "n", "same", "bands"])
        forget()

    return id_and_text(docs).mapInArrow(run, "doc_id long, n long, same binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similar: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets have 100 * intersection >= similar * union, the words themselves being compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            keep, last = [], (None, set())
            for i in range(batch.num_rows):  # the sets of one pair at a time: texts may be long
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if last[0] != row["a"]:
                    last = row["a"], shingles(codec.decompress(row["ta"], decompressed_size=row["na"], asbytes=True).split(), size)
                p, q = last[1], shingles(codec.decompress(row["tb"], decompressed_size=row["nb"], asbytes=True).split(), size)
                common = len(p & q)
                keep.append(100 * common >= similar * (len(p) + len(q) - common) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("node").alias("a"), F.col("packed").alias("ta"), F.col("size").alias("na"))
    two = texts.select(F.col("node").alias("b"), F.col("packed").alias("tb"), F.col("size").alias("nb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "na", "tb", "nb").mapInArrow(run, "a long, b long").distinct()


def packed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, packed and size: the words of the nodes(node, doc_id, same), joined by a space, from the rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in chunks_of(batches, 2_000_000):
            keep, packed, sizes = [], [], []
            for words, same in zip(words_of(b.column("text")), b.column("same").to_pylist()):
                raw = b" ".join(words)
                keep.append(hashlib.sha256(raw).digest() == same)  # an id may have several texts
                if keep[-1]:
                    packed.append(codec.compress(raw, asbytes=True))
                    sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column("node").filter(pa.array(keep, pa.bool_())), pa.array(packed, pa.binary()), pa.array(sizes, pa.int64())], ["node", "packed", "size"])

    found = id_and_text(docs).join(nodes, "doc_id").select("node", "same", "text")
    return found.mapInArrow(run, "node long, packed binary, size long").dropDuplicates(["node"])


def fits(n: str, m: str, similar: int) -> F.Column:
    """Whether sets of these sizes can be similar at all."""
    return 100 * F.least(n, m) >= similar * F.greatest(n, m)


def across(nodes: DataFrame, size: int, similar: int) -> DataFrame:
    """Pairs (a, b) of nodes(node, packed, size, component) in different components that can be similar, by their rarest shingles.

    With all shingles in one order, two sets of similarity s share one among the first n - ceil(s n) + 1 of the larger and the first n - ceil(2 s n / (1 + s)) + 1
    of the smaller: a copy with too many shingles of its own to be linked with anything meets nobody there; and what stands before the first common
    one is not common. The order is by frequency, counted in ``SLOTS`` slots, rarest first; it decides costs alone. Shingles of one component are dropped before
    anything is joined; in each other shingle's bucket the largest component meets the others' nodes only, and a set meets larger ones only.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                yield b, [codec.decompress(p, decompressed_size=n, asbytes=True).split() for p, n in zip(b.column("packed").to_pylist(), b.column("size").to_pylist())]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, np.int64)
        for _, words in texts(batches):
            seen += np.bincount((named(words, size)[0] & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        forget()
        slot = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(seen[slot])], ["slot", "n"])

    found = nodes.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    seen = np.zeros(SLOTS, np.uint8)
    seen[found.column("slot").to_numpy()] = np.minimum(63, 4 * np.log2(found.column("n").to_numpy())).astype(np.uint8)
    often = nodes.sparkSession.sparkContext.broadcast(seen)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in texts(batches):
            names, cuts = shingle_sets(words, size, often.value)
            n = np.diff(cuts)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - cuts[:-1][row]
            keep = place < (n - -(-similar * n // 100) + 1)[row]
            names, row, place = names[keep], row[keep], place[keep]
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *(b.column(c).take(pa.array(row)) for c in ("node", "component")), pa.array(n[row].astype(np.int32)), pa.array(place.astype(np.int32))], ["key", "node", "component", "n", "place"])
        forget()

    side = Window.partitionBy("key")
    first = nodes.mapInArrow(rare, "key long, node long, component long, n int, place int")
    first = saved(first.select("*", F.min("component").over(side).alias("x"), F.max("component").over(side).alias("y")).where("x <> y").drop("x", "y"))
    by_component = first.groupBy("key", "component").count()
    largest = by_component.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    met = first.join(largest, "key")
    one, two = (met.select("key", (F.col("component") == F.col("largest")).alias("major" + x), *(F.col(c).cast("long").alias(c + x) for c in ("node", "n", "component", "place"))) for x in "12")
    # the smaller set is found by fewer of its shingles
    least = -F.floor(-2 * similar * F.col("n1") / F.lit(100.0 + similar))  # so many are common at least
    one = one.where(F.col("place1") < F.col("n1") - least + 1)
    # from the first shingle that both have on, at most so many can be common
    reach = (100 + similar) * F.least(F.col("n1") - F.col("place1"), F.col("n2") - F.col("place2")) >= similar * (F.col("n1") + F.col("n2"))
    larger = (F.col("n1") < F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2"))
    apart = (F.col("component1") != F.col("component2")) & larger & fits("n1", "n2", similar) & reach
    minor = one.join(two.where("not major2"), "key").where(apart).unionByName(one.where("not major1").join(two.where("major2"), "key").where(apart))
    return minor.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def groups(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    marks = stored(sketched(docs, size, bands))
    some = marks.where("doc_id is not null and n > 0")
    wide = some.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    wide = saved(wide.withColumn("node", F.monotonically_increasing_id()))
    classes = saved(wide.select("same", "node", "doc_id"))
    # texts of one id are one document
    ids = some.select("doc_id", "same").distinct()
    several = ids.groupBy("doc_id").count().where("count > 1").join(ids, "doc_id").join(classes.select("same", "node"), "same").select("doc_id", "node")
    own = stored(several.join(several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").where("node <> b").select(F.col("node").alias("a"), "b"))
    banded = wide.select("node", "doc_id", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "node", "n")).alias("lead")).where("m > 1")
    shared = saved(banded.drop("doc_id").join(buckets, "key").select("key", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.doc_id").alias("first_doc")))
    released(wide)
    nodes = shared.select("node").distinct()
    texts = saved(packed_texts(docs, classes.join(nodes, "node", "left_semi")))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("bands"), "first_doc"))
    first = saved(
        shared.where((F.col("node") != F.col("lead")) & fits("n", "lead_n", similar))
        .groupBy("node", "lead").agg(F.count("*").alias("bands"), F.min("first_doc").alias("first_doc"))
        .withColumn("best", best).where("best <= 2")
        .select(F.col("lead").alias("a"), F.col("node").alias("b"))
    )
    links = stored(verified(first, texts, size, similar)).unionByName(own)
    joined = components(links)
    # candidates in different components: only these can still join any
    placed = shared.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    opened = placed.join(mixed, "key", "left_semi").select("node", "component").distinct()
    met = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    opened = saved(texts.join(opened, "node"))
    released(shared)
    rest = stored(across(opened, size, similar).join(met, ["a", "b"], "left_anti"))
    released(opened)
    joined = components(links.unionByName(stored(verified(rest, texts, size, similar))))
    released(texts)
    of = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = of.join(least, "component").select("same", "component_id")
    out = marks.select("doc_id", "n", "same").join(found, "same", "left")
    # documents without shingles stand alone
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The rows of docs without those of a group's later documents."""
    gone = groups(docs, size, similar).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), size=2)
