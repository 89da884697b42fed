"""Operator 6: repeated word windows by recompression.

The words of a text are named, and then renamed in rounds. In each round every maximal run of one symbol becomes a symbol, and every pair of
a *left* symbol before a *right* one (a bit of the symbol's name says which it is) becomes a symbol. Each symbol keeps the range of words that settled
it, its neighbours' part in the decisions included; within that range the symbol is certain: a substring met in any document
gets the same interior symbols, whatever stands around it, but for some at its edges.

Every window of ``length`` words is looked up by the symbol of the last round that is certain inside it, that with the smallest
name if there are several; a window without one (inside a long run) stands for itself.

* A screen comes first: a block names symbols by hashes of their parts, and windows whose symbol, with what is around it, occurs in one
  document only repeat nowhere and are done (pass 1 of repeats). Hashes decide nothing else.
* What is left is named by Spark rounds: one for the words, then one for the runs and one for the pairs of each round. Blocks deal their distinct
  definitions (a word; a symbol and how often it runs; a pair of symbols), a bucket numbers its distinct ones, and the
  numbers go back to the blocks. So names are global and exact: equal names are equal words, without a hash between them.
* Windows are then dealt by their symbol, as the names of their words, and those of one symbol are sorted by these: equal windows are verified name by name.

Words are maximal runs of bytes other than space and 0x09 to 0x0D. Defined results: null and empty texts have no words and
keep the empty string; texts shorter than a window keep all words; of equal texts the smallest id is kept; rows with the same
id do not judge one another; a null id counts as larger than all ids; columns other than doc_id and text are not read unless
carried.
"""

from __future__ import annotations

from collections.abc import Generator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import mix64, saved, table
from quarrystone.llm.repeats import ANSWERS, ANSWERS_SQL, ENTRIES, ENTRIES_SQL, Kernel, Parsed, Ranges, Seeds, by_block, deal_entries, heard, judged, rows_to, runs, valid_starts, without_repeats

#: Words of a window; rounds of recompression, as many as leave each window without runs a certain symbol.
LENGTH, ROUNDS = 13, 2
U = np.uint64
BYTES = mix64(np.arange(301, 557, dtype=U))
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in the bytes, its name, and which word each document begins with."""
    n = len(data)
    inside = ~BLANK[data]
    border = np.zeros(n + 1, bool)
    border[starts] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1] | border[1:-1]
    after[:-1] = before[1:] if n else after[:-1]
    after[:-1] = ~inside[1:] | border[1:-1]
    begin, end = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return begin, end, Ranges(BYTES[data]).name(begin, end), np.searchsorted(begin, starts)


#: The symbols of a sequence: names, and the words that settle each (from left up to right).
Symbols = tuple[np.ndarray, np.ndarray, np.ndarray]
Pairs = tuple[np.ndarray, np.ndarray]


def recompression(words: np.ndarray, units: np.ndarray, rounds: int) -> Generator[Pairs, np.ndarray, Symbols]:
    """The rounds over all documents, runs first, then pairs. It yields the two parts of all that needs a name and is sent the names, not negative.

    A mark, with a negative name, stands before each document and at the end: it joins nothing, and what it settles lies in no window.
    """
    m, k = len(words), len(units)
    at = units + np.arange(k)
    word = np.ones(m + k, bool)
    word[at] = False
    name, left, right = (np.empty(m + k, np.int64) for _ in range(3))
    name[word], left[word], right[word] = words, np.arange(m), np.arange(1, m + 1)
    name[at], left[at], right[at] = -1 - np.arange(k), units - 1, units + 1
    for number in range(1, rounds + 1):
        run = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        size = np.diff(np.append(run, len(name)))
        end = np.append(run[1:], len(name))
        made = name[run]
        bit = mix64(made.astype(U) + U(number * 0x51ED27)) & U(1)
        long = np.flatnonzero(size > 1)
        made[long] = yield made[long], size[long]
        joins = np.zeros(len(made), bool)
        joins[:-1] = (bit[:-1] == 0) & (bit[1:] == 1) & (made[:-1] >= 0) & (made[1:] >= 0)
        pair = np.flatnonzero(joins)
        stay = np.ones(len(made), bool)
        stay[pair + 1] = False
        made[pair] = yield made[pair], made[pair + 1]
        end[pair] = end[pair + 1]
        before, behind = np.maximum(run[stay] - 1, 0), np.minimum(end[stay], len(name) - 1)
        name, left, right = made[stay], left[before], right[behind]
    return name, left, right


def hashed_symbols(names: np.ndarray, units: np.ndarray, rounds: int) -> Symbols:
    """The symbols after the rounds, named by hashes of their parts."""
    going = recompression((names >> U(1)).astype(np.int64), units, rounds)
    try:
        first, second = next(going)
        step = 1
        while True:
            made = mix64(mix64(first.astype(U) + U(step)) * U(0x9FB21C651E98DF25) + second.astype(U))
            first, second = going.send((made >> U(1)).astype(np.int64))
            step += 1
    except StopIteration as done:
        return done.value


def symbol_of_windows(symbols: Symbols, windows: int, length: int) -> np.ndarray:
    """Which symbol stands for each window; a negative number, another for each, where none is certain."""
    name, left, right = symbols
    place = np.arange(windows)
    low = np.cumsum(np.bincount(np.clip(left + 1, 0, windows), minlength=windows + 1))[:windows]  # the first symbol settled at or behind the window's start
    high = np.cumsum(np.bincount(np.clip(right, 0, windows + length), minlength=windows + length + 1))[length : length + windows] - 1  # the last one settled before its end
    width = high - low + 1
    bits = U(len(name).bit_length())
    least = [mix64(name.astype(U) + U(77)) >> bits << bits | np.arange(len(name), dtype=U)]
    anchor = -1 - place
    for level in range(max(1, int(width.max())).bit_length()):
        if level:
            step = 1 << (level - 1)
            least.append(np.minimum(least[-1][:-step], least[-1][step:]))
        at = np.flatnonzero((width >= 1 << level) & (width < 2 << level))
        best = np.minimum(least[-1][low[at]], least[-1][high[at] - (1 << level) + 1])
        anchor[at] = (best & U((1 << int(bits)) - 1)).astype(np.int64)
    return anchor


def name_digits(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two words from each place on, as a number; contents are global names of words."""
    _, ids = np.unique(np.frombuffer(b"".join(contents), np.int64), return_inverse=True)
    out = ids.astype(np.int64) << 32
    out[:-1] |= ids[1:]
    return out, np.asarray([len(c) // 8 for c in contents], np.int64)


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in their order, and which of them each pair is."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return a[new], b[new], of


DEFINITIONS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary())])
DEFINITIONS_SQL = "bucket int, block long, first binary, second binary"


def distinct_words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct words of contents that end at these places, which of them each word is, and which word each content begins with.

    Words of a content have one space between them, and no content is empty.
    """
    space = np.flatnonzero(data == 0x20)
    gap = np.sort(np.concatenate([space, ends]))  # behind each word
    inside = np.searchsorted(space, ends)
    kept = np.concatenate([[0], gap - np.searchsorted(space, gap)]).astype(np.int32)  # where words begin and end without the spaces
    words = pa.Array.from_buffers(pa.binary(), len(gap), [None, pa.py_buffer(kept), pa.py_buffer(data[data != 0x20])]).dictionary_encode()
    known = pa.concat_arrays([words.dictionary])  # its buffers begin with its first word
    return known, words.indices.to_numpy().astype(np.int64), np.concatenate([[0], inside + np.arange(1, len(ends) + 1)])


class Stretches:
    """The open stretches of a block (a row of entries), and the names that answers hold: those of step s under pass -1 - s."""

    def __init__(self, row: dict, answers: pa.Table, buckets: int, rounds: int):
        sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        raw = pa.Codec("zstd").decompress(row["contents"], decompressed_size=int(sizes.sum()), asbytes=True)
        self.block, self.doc, self.windows = row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["windows"], np.uint32).astype(np.int64)
        self.known, self.of, self.units = distinct_words(np.frombuffer(raw, np.uint8), np.cumsum(sizes))
        self.heard = {(-1 - number, b): yes for number, b, yes in zip(*(answers.column(c).to_pylist() for c in ("pass", "bucket", "yes"))) if number < 0}
        self.buckets, self.rounds = buckets, rounds

    def dealt(self, bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of definitions by bucket, and each bucket with its part of that order."""
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1)).tolist()
        return order, [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]

    def names(self, step: int, bucket: np.ndarray) -> np.ndarray:
        order, parts = self.dealt(bucket)
        out = np.empty(len(bucket), np.int64)
        for b, x, y in parts:
            out[order[x:y]] = np.frombuffer(self.heard[step, b], np.int64)
        return out

    def asked(self, upto: int) -> list[tuple]:
        """What step ``upto`` has to name, once the steps before it are heard; nothing if there is no such step."""
        return self.go(upto)[0]

    def named(self) -> tuple[np.ndarray, Symbols]:
        """The names of the words, and the symbols after all rounds."""
        return self.go(1 + 2 * self.rounds)[1]

    def go(self, upto: int) -> tuple[list[tuple], tuple[np.ndarray, Symbols] | None]:
        at = np.frombuffer(self.known.buffers()[1], np.int32)
        bucket = (Ranges(BYTES[np.frombuffer(self.known.buffers()[2], np.uint8)]).name(at[:-1], at[1:]) % U(self.buckets)).astype(np.int64)
        if upto == 0:
            order, parts = self.dealt(bucket)
            by = self.known.take(pa.array(order)).to_pylist()
            return [(b, self.block, b" ".join(by[x:y]), b"") for b, x, y in parts], None
        ids = self.names(0, bucket)[self.of]
        going = recompression(ids, self.units, self.rounds)
        try:
            parts_of = next(going)
            for step in range(1, upto + 1):
                a, b, of = distinct(*parts_of)
                bucket = (mix64(mix64(a.astype(U)) * U(3) + b.astype(U)) % U(self.buckets)).astype(np.int64)
                if step == upto:
                    order, parts = self.dealt(bucket)
                    return [(k, self.block, a[order[x:y]].tobytes(), b[order[x:y]].tobytes()) for k, x, y in parts], None
                parts_of = going.send(self.names(step, bucket)[of])
        except StopIteration as done:
            return [], (ids, done.value)


def numbered(definitions: pa.Table, step: int, steps: int, buckets: int) -> pa.Table:
    """Names for the definitions of a bucket: the place among its distinct ones, apart from the names of other buckets and steps."""
    rows = definitions.sort_by("block").to_pylist()
    if step == 0:
        met = [r["first"].split(b" ") for r in rows]
        number = {w: i for i, w in enumerate(sorted(set().union(*met)))}
        found = [np.fromiter((number[w] for w in ws), np.int64, len(ws)) for ws in met]
    else:
        first, second = (np.concatenate([np.frombuffer(r[c], np.int64) for r in rows]) for c in ("first", "second"))
        found = np.split(distinct(first, second)[2], np.cumsum([len(r["first"]) // 8 for r in rows])[:-1])
    return rows_to(ANSWERS, [(r["block"], -1 - step, r["bucket"], ((f * buckets + r["bucket"]) * steps + step).tobytes()) for r, f in zip(rows, found)])


class Named:
    """The windows of a block's stretches by their symbols, as names of words: what is dealt (see Dealt), and the answer made of its answers."""

    def __init__(self, own: Stretches, length: int):
        ids, symbols = own.named()
        valid = valid_starts(own.units, length)
        anchor = symbol_of_windows(symbols, len(valid), length)
        self.first, last = runs(valid, anchor)
        chosen = anchor[self.first]
        alone = Ranges(mix64(ids.astype(U))).name(self.first, self.first + length)
        key = np.where(chosen < 0, alone, mix64(symbols[0][np.maximum(chosen, 0)].astype(U)))
        self.size = last - self.first + 1
        self.owner = own.doc[np.searchsorted(own.units, self.first, side="right") - 1]
        raw, place = ids.tobytes(), {}
        self.of = np.fromiter((place.setdefault((k, raw[8 * a : 8 * b]), len(place)) for k, a, b in zip(key.tolist(), self.first.tolist(), (last + length).tolist())), np.int64, len(key))
        self.contents = [c for _, c in place]
        self.key, self.windows = np.empty(len(place), U), np.empty(len(place), np.int64)
        self.key[self.of], self.windows[self.of] = key, self.size
        self.doc = np.full(len(place), np.iinfo(np.int64).max)
        np.minimum.at(self.doc, self.of, self.owner)

    def answer(self, repeated: np.ndarray) -> np.ndarray:
        """Of each window of the stretches, in their order, whether a smaller document has the same. repeated: of the windows dealt."""
        begins = np.cumsum(self.windows) - self.windows
        at = np.repeat(begins[self.of] - (np.cumsum(self.size) - self.size), self.size) + np.arange(int(self.size.sum()))
        return np.repeat(self.owner > self.doc[self.of], self.size) | repeated[at]


def by_names(length: int, rounds: int, entries: DataFrame, buckets: int) -> DataFrame:
    """The answers of pass 2: rounds name the stretches' symbols, windows meet by symbol, their words' names decide."""
    steps = 1 + 2 * rounds
    entries = by_block(entries)
    names: DataFrame | None = None
    kernel = word_kernel(length, rounds)

    def together(own: pa.Table, answers: pa.Table) -> list[Stretches]:
        return [Stretches(row, answers, buckets, rounds) for row in own.to_pylist()]

    def ask(step: int):
        return lambda own, answers: rows_to(DEFINITIONS, [x for s in together(own, answers) for x in s.asked(step)])

    def name_them(step: int):
        return lambda definitions: numbered(definitions, step, steps, buckets)

    def first_ask(own: pa.Table) -> pa.Table:
        return ask(0)(own, ANSWERS.empty_table())

    for step in range(steps):
        asked = entries.groupBy("block").applyInArrow(first_ask, DEFINITIONS_SQL) if names is None else entries.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(ask(step), DEFINITIONS_SQL)
        made = saved(asked.groupBy("bucket").applyInArrow(name_them(step), ANSWERS_SQL))
        names = made if names is None else names.unionByName(made)

    def spread(own: pa.Table, answers: pa.Table) -> pa.Table:
        return rows_to(ENTRIES, [x for s in together(own, answers) for x in deal_entries(s.block, Named(s, length), buckets)])

    def settle(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for s in together(own, answers):
            made = Named(s, length)
            bits = made.answer(heard(answers, 2, made.key, made.windows, buckets))
            if bits.any():
                out.append((s.block, 2, 0, np.packbits(bits).tobytes()))
        return rows_to(ANSWERS, out)

    dealt = entries.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(spread, ENTRIES_SQL)
    repeated = dealt.groupBy("bucket").applyInArrow(lambda t: judged(t, kernel, length), ANSWERS_SQL)
    return entries.groupBy("block").cogroup(names.unionByName(repeated).groupBy("block")).applyInArrow(settle, ANSWERS_SQL)


def word_kernel(length: int = LENGTH, rounds: int = ROUNDS) -> Kernel:
    def parse(data: np.ndarray, starts: np.ndarray) -> Parsed:
        begin, end, names, units = words(data, starts)
        ranges = Ranges(names)

        def spaced(stay: np.ndarray) -> tuple[bytes, np.ndarray]:
            """The words at these places with a space behind each, and where each begins."""
            out = np.full(len(data) + 1, 0x20, np.uint8)
            out[:-1] = np.where(BLANK[data], 0x20, data)
            b, size = begin[stay], end[stay] - begin[stay] + 1
            total = np.concatenate([[0], np.cumsum(size)])
            joined = out[np.arange(int(total[-1])) + np.repeat(b - total[:-1], size)]
            joined[total[1:] - 1] = 0x20
            return joined.tobytes(), total

        def content(first: np.ndarray, last: np.ndarray) -> list[bytes]:
            raw, at = spaced(np.arange(len(begin)))
            return [raw[x:y] for x, y in zip(at[first].tolist(), (at[last] - 1).tolist())]

        def keep(gone: np.ndarray) -> list[bytes]:
            stay = np.flatnonzero(~gone)
            raw, total = spaced(stay)
            cut = total[np.searchsorted(stay, units)].tolist()
            return [raw[x : max(x, y - 1)] for x, y in zip(cut, cut[1:])]

        empty = np.zeros(0, np.int64)
        valid = valid_starts(units, length)
        if not valid.any():
            return Parsed(units, Seeds(empty, empty, empty, empty.astype(U)), content, keep)
        name, left, right = made = hashed_symbols(names, units, rounds)
        anchor = symbol_of_windows(made, len(valid), length)
        first, last = runs(valid, anchor)
        chosen = anchor[first]
        alone = chosen < 0
        symbol = np.maximum(chosen, 0)
        a, b = np.where(alone, first, left[symbol]), np.where(alone, first + length, right[symbol])
        key = ranges.name(a, b) + alone.astype(U)
        doc = np.searchsorted(units, first, side="right") - 1
        return Parsed(units, Seeds(doc, first, last, key), content, keep)

    return Kernel(parse, name_digits, min(2, length), partial(by_names, length, rounds))


def substring_dedup(docs: DataFrame, length: int = LENGTH, carried: list[str] | None = None) -> DataFrame:
    """Of each document: doc_id, n_units (words), n_removed, spans (in words), kept (UTF-8 of the words left, joined by a space)."""
    return without_repeats(docs, word_kernel(length), length, carried)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
