"""Repeated windows of fixed length across documents, the frame that operators 2 and 6 share.

A *window* is ``length`` consecutive units (bytes or words) of one document. The frame marks every window that also
starts in a document with a smaller id, exactly, without sending a row for each window:

* A kernel names, for every window, an *anchor* inside it by a rule that sees the window's content only, so equal windows
  have equal anchors. Neighbouring windows mostly share their anchor; such a run of windows is a *seed*, with a ``key``,
  a hash of the content around the anchor.
* Pass 1 is a filter: each block of documents deals the keys of its seeds. A key of one document is done, as its windows
  repeat nowhere. Keys are hashes; where two collide, more stays open, nothing is lost.
* Pass 2 decides over the real content of the open seeds. A kernel with a ``judge`` brings its own (operator 6: rounds that name symbols); it
  gets the open seeds of a block as one row, neighbours joined to stretches. Otherwise seeds are dealt by key, and a bucket
  sorts the windows (the suffixes of the seeds, down to ``length`` units) by most-significant-digit passes over that content: each pass splits
  the groups by the next digit and drops groups of one document; the groups left after the last digit are exactly the repeated windows.
* Answers return to the blocks as bits, in the order of what was sent.

Blocks hold some megabytes of text each and merge their own copies before anything is dealt, so a passage that every
document shares sends one entry a block, and no group of copies ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import NO_ID, mix64, saved, shuffle_partitions, text_batches

#: Bytes of text in a block.
BLOCK = 2_000_000
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base to the powers 0 to n-1, modulo 2**64."""
    have = cache.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(1, U)
        while len(have) < size:
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        cache[base] = have
    return have[:n]


class Ranges:
    """Names of the ranges of a sequence of 64-bit values; equal content has equal names."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), n + 1)

    def name(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Seeds:
    """The seeds of a block, in the order of the documents: windows first to last of document doc."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    key: np.ndarray


@dataclass
class Parsed:
    """What a kernel makes of a block: unit ``units[d]`` to ``units[d + 1]`` are document d's."""

    units: np.ndarray
    seeds: Seeds
    content: Callable[[np.ndarray, np.ndarray], list[bytes]]  # of the units from each start to each end
    keep: Callable[[np.ndarray], list[bytes]]  # from a mark for each unit removed, what is left of each document


@dataclass
class Kernel:
    """parse: a block's bytes and where its documents begin. digits: from contents, a number for each place in all of them, of ``wide`` units
    from there on, and how many units each content has; equal digits are equal units. judge: the answers of pass 2 from the entries, dealt to
    one bucket, and a number of buckets."""

    parse: Callable[[np.ndarray, np.ndarray], Parsed]
    digits: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    wide: int
    judge: Callable[[DataFrame, int], DataFrame] | None = None


def runs(valid: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of valid places with one anchor."""
    edge = np.ones(len(valid) + 1, bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    return np.flatnonzero(edge[:-1] & valid), np.flatnonzero(edge[1:] & valid)


def valid_starts(units: np.ndarray, length: int) -> np.ndarray:
    """Whether a window that starts at a unit ends in the same document."""
    ok = np.ones(int(units[-1]), bool)
    for a, b in zip(units[:-1].tolist(), units[1:].tolist()):
        ok[max(a, b - length + 1) : b] = False
    return ok[: max(0, len(ok) - length + 1)]


def blocks_of(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks of documents sorted by id: block, ids, nulls, sizes, data, extra (the carried columns). Written once, by block."""
    spark = docs.sparkSession
    text_batches(spark)
    names = [f"c{i}" for i in range(len(carried))]
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").cast("long").isNull().alias("no_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, count, part = pa.Codec("zstd", compression_level=1), 0, TaskContext.get().partitionId()

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal count
            table = pa.Table.from_batches(rows)
            table = table.take(pa.array(np.argsort(table.column("doc_id").to_numpy(), kind="stable"))).combine_chunks()
            texts = table.column("text").cast(pa.large_binary()).fill_null(b"").combine_chunks()
            sizes = pa.compute.binary_length(texts).to_numpy().astype(np.int64)
            data = b"".join(texts.to_pylist())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.select(names).schema) as w:
                w.write_table(table.select(names))
            count += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part << 32 | count, pa.int64()), (table.column("doc_id").to_numpy().tobytes(), pa.binary()), (np.packbits(table.column("no_id").to_numpy()).tobytes(), pa.binary()), (sizes.tobytes(), pa.binary()), (codec.compress(data, asbytes=True), pa.binary()), (codec.compress(sink.getvalue(), asbytes=True), pa.binary()), (sink.getvalue().size, pa.int64()))],
                ["block", "ids", "nulls", "sizes", "data", "extra", "extra_size"],
            )

        rows, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            beside = 16 + max(0, batch.nbytes - int(lengths.sum())) // batch.num_rows  # of a row's other columns
            at = 0
            for i, n in enumerate((lengths + beside).tolist()):
                if size and size + n > BLOCK:
                    rows.append(batch.slice(at, i - at))
                    yield block(rows)
                    rows, size, at = [], 0, i
                size += n
            rows.append(batch.slice(at))
        if any(r.num_rows for r in rows):
            yield block(rows)

    return by_block(narrow.mapInArrow(run, "block long, ids binary, nulls binary, sizes binary, data binary, extra binary, extra_size long"))


def by_block(df: DataFrame) -> DataFrame:
    """df written once, dealt by block."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan forgets how its rows are dealt
    try:
        return saved(df.repartition(2 * shuffle_partitions(spark), "block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


class Block:
    """A row of blocks_of, parsed, and what it sends in both passes."""

    def __init__(self, row: dict, kernel: Kernel, length: int):
        self.ids, self.length = np.frombuffer(row["ids"], np.int64), length
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.ids)).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        raw = pa.Codec("zstd").decompress(row["data"], decompressed_size=int(self.starts[-1])) if self.starts[-1] else b""
        self.parsed = kernel.parse(np.frombuffer(raw, np.uint8), self.starts)
        s = self.parsed.seeds
        # upper 48 bits, as they are sent
        self.keys, self.of = np.unique(s.key >> U(16), return_inverse=True)
        self.keys <<= U(16)
        doc = self.ids[s.doc]
        low, high = np.full(len(self.keys), NO_ID), np.full(len(self.keys), -NO_ID - 1)
        np.minimum.at(low, self.of, doc)
        np.maximum.at(high, self.of, doc)
        self.several = low < high

    def open(self, shared: np.ndarray, joined: bool) -> None:
        """The entries of the seeds whose key others have too, in other blocks (shared) or here: one for each content, of its smallest id."""
        s = self.parsed.seeds
        begin = end = np.flatnonzero((shared | self.several)[self.of])
        if joined and len(begin):
            cut = (s.doc[end[1:]] != s.doc[end[:-1]]) | (s.first[end[1:]] != s.last[end[:-1]] + 1)
            begin, end = end[np.concatenate([[True], cut])], end[np.concatenate([cut, [True]])]
        self.open_seeds = s = Seeds(s.doc[begin], s.first[begin], s.last[end], s.key[begin])
        found = self.parsed.content(s.first, s.last + self.length)
        place: dict[bytes, int] = {}
        self.entry = np.fromiter((place.setdefault(c, len(place)) for c in found), np.int64, len(found))
        owner = np.full(len(place), len(found))
        np.minimum.at(owner, self.entry, np.arange(len(found)))  # seeds are in the order of ids
        self.contents = list(place)
        self.key, self.windows, self.doc = s.key[owner], s.last[owner] - s.first[owner] + 1, self.ids[s.doc[owner]]

    def removed(self, repeated: np.ndarray) -> np.ndarray:
        """A mark for each unit that a repeated window covers. repeated: of all windows of the entries."""
        s = self.open_seeds
        n = int(self.parsed.units[-1])
        first, size = s.first, self.windows[self.entry]
        later = self.ids[s.doc] > self.doc[self.entry]
        begins = np.cumsum(self.windows) - self.windows
        starts = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        gone = np.repeat(later, size) | repeated[np.repeat(begins[self.entry], size) + starts]
        starts = (np.repeat(first, size) + starts)[gone]
        edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + self.length, minlength=n + 1)
        return np.cumsum(edge[:-1]) > 0


def six(x: np.ndarray) -> bytes:
    """The upper 48 bits of each."""
    return (x >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def places(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each bucket in their order, and where each bucket's begin. Keys count by their upper 48 bits."""
    bucket = (mix64((key >> U(16)) ^ U(0xA5A5)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


KEYS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary())])
ENTRIES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("windows", pa.binary()), ("sizes", pa.binary()), ("contents", pa.binary())])
ANSWERS = pa.schema([("block", pa.int64()), ("pass", pa.int32()), ("bucket", pa.int32()), ("yes", pa.binary())])
KEYS_SQL, ANSWERS_SQL = "bucket int, block long, keys binary", "block long, pass int, bucket int, yes binary"
ENTRIES_SQL = "bucket int, block long, keys binary, ids binary, windows binary, sizes binary, contents binary"


def rows_to(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def deal_keys(block: int, keys: np.ndarray, buckets: int) -> list[tuple]:
    order, cuts = places(keys, buckets)
    return [(b, block, six(keys[order[cuts[b] : cuts[b + 1]]])) for b in np.flatnonzero(np.diff(cuts)).tolist()]


class Dealt(Protocol):
    """What pass 2 deals: of each entry its key, content, document and number of windows."""

    key: np.ndarray
    contents: list[bytes]
    doc: np.ndarray
    windows: np.ndarray


def deal_entries(block: int, made: Dealt, buckets: int) -> list[tuple]:
    order, cuts = places(made.key, buckets)
    codec, out = pa.Codec("zstd", compression_level=1), []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        at = order[cuts[b] : cuts[b + 1]]
        contents = [made.contents[i] for i in at.tolist()]
        sizes = np.asarray([len(c) for c in contents], np.uint32)
        out.append((b, block, six(made.key[at]), made.doc[at].tobytes(), made.windows[at].astype(np.uint32).tobytes(), sizes.tobytes(), codec.compress(b"".join(contents), asbytes=True)))
    return out


def shared_keys(table: pa.Table) -> pa.Table:
    """Of the keys of a bucket: whether another block has the same (a block sends a key once)."""
    rows = table.sort_by("block").to_pylist()
    key = np.concatenate([unsix(r["keys"]) for r in rows])
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    shared = np.zeros(len(key), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    out, begin = [], 0
    for r in rows:
        end = begin + len(r["keys"]) // 6
        if shared[begin:end].any():
            out.append((r["block"], 1, r["bucket"], np.packbits(shared[begin:end]).tobytes()))
        begin = end
    return rows_to(ANSWERS, out)


def regrouped(group: np.ndarray, digit: np.ndarray, doc: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass: the windows (rest) whose groups, split by the digit, still hold several documents; their groups; the least document of each."""
    order = np.lexsort((digit, group))
    g, d = group[order], digit[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(new)
    made = np.cumsum(new) - 1
    low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
    stay = (low < high)[made]
    return rest[order[stay]], made[stay], low[made[stay]]


def radix_sorted(key: np.ndarray, doc: np.ndarray, digits: np.ndarray, begin: np.ndarray, windows: np.ndarray, length: int, wide: int) -> np.ndarray:
    """Of all windows of contents (content i has ``windows[i]``, from place ``begin[i]`` of the digits): whether a smaller document has the same."""
    owner = np.repeat(np.arange(len(key)), windows)
    place = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(len(owner))
    repeated = np.zeros(len(owner), bool)
    if not len(owner):
        return repeated
    # the first digit is the anchor's key; the others are units of the window itself, the last digit reaching back to end with it
    rest, group, least = regrouped(np.zeros(len(owner), np.int64), key[owner], doc[owner], np.arange(len(owner)))
    for at in dict.fromkeys([*range(0, length - wide, wide), max(0, length - wide)]):
        if not len(rest):
            break
        rest, group, least = regrouped(group, digits[place[rest] + at], doc[owner[rest]], rest)
    repeated[rest] = doc[owner[rest]] > least
    return repeated


def judged(table: pa.Table, kernel: Kernel, length: int) -> pa.Table:
    """Of all windows of the entries of a bucket: whether a smaller id has the same."""
    rows = table.sort_by("block").to_pylist()
    codec, place, of = pa.Codec("zstd"), {}, []
    for r in rows:
        sizes = np.frombuffer(r["sizes"], np.uint32).astype(np.int64)
        raw = codec.decompress(r["contents"], decompressed_size=int(sizes.sum()), asbytes=True)
        cuts = [0, *np.cumsum(sizes).tolist()]
        of += [place.setdefault(raw[a:b], len(place)) for a, b in zip(cuts, cuts[1:])]
    entry = np.asarray(of, np.int64)
    key, doc = np.concatenate([unsix(r["keys"]) for r in rows]), np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
    windows = np.concatenate([np.frombuffer(r["windows"], np.uint32) for r in rows]).astype(np.int64)
    n = len(place)
    least, a_key, a_windows = np.full(n, NO_ID), np.zeros(n, U), np.zeros(n, np.int64)
    np.minimum.at(least, entry, doc)
    a_key[entry], a_windows[entry] = key, windows
    digits, sizes = kernel.digits(list(place))
    repeated = radix_sorted(a_key, least, digits, np.cumsum(sizes) - sizes, a_windows, length, kernel.wide)
    begins = np.cumsum(a_windows) - a_windows
    out, at = [], 0
    for r in rows:
        end = at + len(r["keys"]) // 6
        size, e = windows[at:end], entry[at:end]
        bits = np.repeat(doc[at:end] > least[e], size) | repeated[np.repeat(begins[e] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        if bits.any():
            out.append((r["block"], 2, r["bucket"], np.packbits(bits).tobytes()))
        at = end
    return rows_to(ANSWERS, out)


def heard(answers: pa.Table, number: int, key: np.ndarray, size: np.ndarray, buckets: int) -> np.ndarray:
    """The answers for entries with these keys, each of ``size`` bits, in the order of the entries."""
    yes = np.zeros(int(size.sum()), bool)
    begins = np.cumsum(size) - size
    order, cuts = places(key, buckets)
    for r in answers.to_pylist():
        if r["pass"] == number:
            at = order[cuts[r["bucket"]] : cuts[r["bucket"] + 1]]
            n = size[at]
            to = np.repeat(begins[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yes[to] = np.unpackbits(np.frombuffer(r["yes"], np.uint8), count=len(to)).astype(bool)
    return yes


RESULT = [("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]


def without_repeats(docs: DataFrame, kernel: Kernel, length: int, carried: list[str] | None = None) -> DataFrame:
    """Of each document: doc_id, n_units, n_removed, spans (array of start and end, in units), kept (binary), and the carried columns.

    A carried column comes back as ``carried.<name>`` of a struct, whatever its name.
    """
    carried = carried or []
    spark = docs.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    dealt = 1 if kernel.judge else buckets
    blocks = blocks_of(docs, carried)
    fields = [docs.schema[c] for c in carried]

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from rows_to(KEYS, deal_keys(row["block"], Block(row, kernel, length).keys, buckets)).to_batches()

    def opened(row: dict, answers: pa.Table) -> Block:
        block = Block(row, kernel, length)
        block.open(heard(answers, 1, block.keys, np.ones(len(block.keys), np.int64), buckets), bool(kernel.judge))
        return block

    def send_entries(own: pa.Table, answers: pa.Table) -> pa.Table:
        return rows_to(ENTRIES, [x for row in own.to_pylist() for x in deal_entries(row["block"], opened(row, answers), dealt)])

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in own.to_pylist():
            block = opened(row, answers)
            gone = block.removed(heard(answers, 2, block.key, block.windows, dealt))
            units = block.parsed.units
            edge = np.zeros(len(gone) + 1, bool)
            edge[1:-1] = gone[1:] != gone[:-1]
            edge[units] = True  # spans end with the document
            starts, ends = np.flatnonzero(edge[:-1] & gone), np.flatnonzero(edge[1:] & gone) + 1
            first = np.searchsorted(starts, units)
            base = units[np.searchsorted(units, starts, side="right") - 1]
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["start", "end"]))
            total = np.concatenate([[0], np.cumsum(gone)])
            ids = pa.array(block.ids, mask=block.nulls)
            columns = [ids, pa.array(np.diff(units)), pa.array(np.diff(total[units])), spans, pa.array(block.parsed.keep(gone), pa.binary())]
            if carried:
                extra = pa.ipc.open_stream(pa.Codec("zstd").decompress(row["extra"], decompressed_size=row["extra_size"])).read_all().combine_chunks()
                columns.append(pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in extra.columns], carried))
            out.append(pa.Table.from_arrays(columns, [n for n, _ in RESULT] + ["carried"] * bool(carried)))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], t) for _, t in RESULT], [n for n, _ in RESULT])

    body = ["block", "ids", "nulls", "sizes", "data"]
    first = saved(blocks.select(*body).mapInArrow(send_keys, KEYS_SQL).groupBy("bucket").applyInArrow(shared_keys, ANSWERS_SQL))
    entries = blocks.select(*body).groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send_entries, ENTRIES_SQL)
    second = kernel.judge(entries, buckets) if kernel.judge else entries.groupBy("bucket").applyInArrow(lambda t: judged(t, kernel, length), ANSWERS_SQL)
    schema = "doc_id long, n_units long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    if carried:
        inner = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields)
        schema += f", carried struct<{inner}>"
    return blocks.groupBy("block").cogroup(first.unionByName(second).groupBy("block")).applyInArrow(finish, schema)
