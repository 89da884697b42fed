"""Operator 7: best-fit packing of tokenised documents into sequences of fixed capacity, by exact-complement hashing.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths: at most ``capacity``
numbers, whatever the size of the corpus. From the longest length down, the gap that a piece leaves is looked up among
the lengths at hand (single), then among the sums of two (pair) and of three (triple); a combination that fills the gap
exactly is used as many times at once as the counts allow. What has no exact complement is placed best-fit, longest
first. The plan says which range of ranks among the pieces of a length goes to which run of sequences at which offset;
it has a few thousand rows at any size. Ranks come from counts by block and length, so no task sees all pieces of a
length.

Defined results: null and empty texts are the end id alone; a document longer than the capacity is cut into pieces of
it, the last one may be shorter; repeated rows are pieces of their own; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import chunks_of, id_and_text, saved, table, without_collector

CAPACITY, END = 4096, 1
#: Bytes of text whose words are looked up together.
SLICE = 2 << 20
#: Marks that part from the letters before them.
MARKS = "!#$%&*+,-./:;=?@^~"
#: Words of characters below this one, and not longer than that, are left to the faster library.
COMPARED, LONG = 0x250, 500
#: What follows each run that the tokenizer parts, for the faster library.
STOP = "\0"

#: Texts that show whether words can be encoded one by one, in lower case, apart from the marks behind them.
PROBES = ["", " ", "Two  words.", "ÉTÉ e\u0301te\u0301 Straße İ", "don't stop, it's 12.5%!", "a\tb\nc\u00a0d\u3000e", "漢字 かな", "x_y-z (q) \"r\"", "\U0001f600 end..."]


class WordTokenizer:
    """Ids of a tokenizer that never joins over white space, remembered by word.

    Its table is handed to a faster library, which merges by the same ranks: it knows no ends of words, so each run gets a STOP
    behind it, which joins the last byte before any other merge. Both must encode alike: each character is compared once, in
    places that tell its class; words of others, and those with a special token, are left to the file's own library.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        file = json.loads(self.tokenizer.to_str())
        mark = file["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.merge_as(file, mark)
        self.remembered = remembered
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        whole = [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        if self.batch(PROBES) != whole:
            raise ValueError("this tokenizer does not lower-case, normalise and part texts at spaces and marks as the memory of words needs it")

    def merge_as(self, file: dict, mark: str) -> None:
        """Prepares merged() from the tokenizer's table, and the search for what a word must not hold for it."""
        import tiktoken

        vocab, merges = file["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        # a byte that prints stands for itself in the table, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.others = re.compile("")  # all words, unless the table is one of bytes with a merge for each longer piece
        if not all(c in vocab and c + mark in vocab for c in byte) or not set(byte).issuperset("".join(a + b.removesuffix(mark) for a, b in merges)):
            return
        pieces = [*(c + mark for c, b in byte.items() if b), *("".join(m) for m in merges), *byte]
        spelt = [bytes(map(byte.__getitem__, t.removesuffix(mark))) + b"\0" * t.endswith(mark) for t in pieces]
        ranks = {t: i for i, t in enumerate(spelt)}
        if len(ranks) < len(pieces):
            return
        self.fast = tiktoken.Encoding("ranks", pat_str=f"[^{STOP}]+{STOP}", mergeable_ranks=ranks, special_tokens={})
        self.number = np.asarray([vocab[t] for t in pieces], "<u4")
        self.blank = vocab[next(c for c, b in byte.items() if b == 32) + mark]
        known = {c for c in map(chr, range(1, COMPARED)) if not c.isspace() and len(c.lower()) == 1 and ord(c.lower()) < COMPARED}
        self.part_by(known)
        probes = [(c, f"x{c}x{c}1{c}1{c}.{c}.{c} {c} {c}{c} '{c}s{c}'s{c}") for c in sorted(known)]
        whole = self.encoded([t for _, t in probes])
        alike = {c for (c, t), ids in zip(probes, whole) if b"".join(self.merged(t.split(" "))) == ids}
        alike = {c for c in alike if c.lower() in alike}
        self.part_by(alike)
        added = [re.escape(x["content"]) for x in file["added_tokens"]]
        self.others = re.compile("|".join([f"[^ {''.join(map(re.escape, sorted(alike)))}]", *added]))

    def part_by(self, known: set[str]) -> None:
        letters, numbers = ("".join(re.escape(c) for c in sorted(known) if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ {letters}{numbers}]+| ")

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of each word by the faster library; a blank, which no word holds, shows where a word ends."""
        parts = self.parts.findall(" ".join(words).lower())
        ids = self.number[np.asarray(self.fast.encode_ordinary(STOP.join(parts) + STOP), np.int64)]
        raw, blanks = ids.tobytes(), (4 * np.flatnonzero(ids == self.blank)).tolist()
        return [raw[a:b] for a, b in zip([0, *(x + 4 for x in blanks)], [*blanks, len(raw)])]

    def encoded(self, words: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, missing: list[str]) -> None:
        """Remembers the ids of the words.

        Those for the faster library are encoded by it. Of the others, letters, and the marks behind them, are encoded apart, as
        the tokenizer itself parts them; letters in lower case, as it makes them; new runs of letters as one text, which is cut
        at the word ends.
        """
        recent, older, tails = self.recent, self.older, self.tails
        plain = missing
        if self.others.search(" ".join(missing)) or max(map(len, missing), default=0) > LONG:
            plain = [w for w in missing if len(w) <= LONG and not self.others.search(w)]
            missing = list(set(missing).difference(plain))
        else:
            missing = []
        if plain:
            recent.update(zip(plain, self.merged(plain)))
        new, parted, others = set(), [], []
        for w in missing:
            core = w.rstrip(MARKS)
            if not core.isalpha() or not core.isascii() and (not unicodedata.is_normalized("NFC", core) or "\u03a3" in core or not core.lower().isalpha()):
                others.append(w)
                continue
            tail = w[len(core) :]
            if tail and tail not in tails:
                tails[tail] = self.encoded([tail])[0]
            core = core.lower()
            known = recent.get(core) or older.get(core)
            if known is None:
                new.add(core)
                parted.append((w, core, tail))
            else:
                recent[w] = known + tails[tail] if tail else known
        plain = list(new)
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                recent.update((w, raw[a:b]) for w, a, b in zip(part, at, at[1:]))
            else:  # a letter that the normaliser turns into more than letters
                recent.update(zip(part, self.encoded(part)))
        recent.update((w, recent[core] + tails[tail] if tail else recent[core]) for w, core, tail in parted)
        if others:
            recent.update(zip(others, self.encoded(others)))
        if len(tails) > 100_000:
            self.tails = {}

    def batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as unsigned 32-bit numbers, little-endian."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        cut = pa.compute.ascii_split_whitespace(column.fill_null(""))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.recent) > self.remembered:
            self.older, self.recent = self.recent, {}
        recent, older = self.recent, self.older
        recent[""] = b""
        known = list(map(recent.get, words))
        unknown = [w for w, ids in zip(words, known) if ids is None]
        if unknown:
            missing = []
            for w, ids in zip(unknown, map(older.get, unknown)):
                if ids is None:
                    missing.append(w)
                else:
                    recent[w] = ids
            self.learn(missing)
            found = map(recent.__getitem__, unknown)
            known = [next(found) if ids is None else ids for ids in known]
        # what stands for the words, one after another, and where each text begins and ends in it
        ids = pa.array(known, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        at = ends[cut.offsets.to_numpy()].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of the documents, with the block they were made in and their rank among its pieces of their length."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int32()), ("rank", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block, tail = tokenizer(path), TaskContext.get().partitionId(), np.asarray([end], "<u4").tobytes()
        met = np.zeros(capacity + 1, np.int64)
        for batch in chunks_of(batches, SLICE):
            out = []
            with without_collector():  # the words' memory holds no cycles
                encoded = words.batch(batch.column("text"))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc, k, at // 4, n, zlib.crc32(part), block, met[n]))
                    met[n] += 1
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long")


def complements(counts: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One to three lengths at hand that sum to the gap, the longest possible first; None if there are none.

    counts[l] says how many pieces of length l are at hand.
    """
    if counts[gap] > 0:
        return (gap,)
    have = counts > 0

    def pair(total: int, spare: int = 0) -> tuple[int, int] | None:
        """Two lengths with that sum, one piece of length ``spare`` being spoken for."""
        if total < 2:
            return None
        b = np.arange((total + 1) // 2, total)
        fits = b[have[b] & have[total - b]][::-1]
        for x in fits[:4].tolist():
            need: dict[int, int] = {}
            for l in (x, total - x, *([spare] if spare else [])):
                need[l] = need.get(l, 0) + 1
            if all(counts[l] >= k for l, k in need.items()):
                return x, total - x
        return None

    if found := pair(gap):
        return found
    # which sums two lengths at hand make, counts apart: the index of pair sums, looked up for the third, all from the longest down
    sums = np.fft.irfft(np.fft.rfft(have[: gap + 1], 2 * gap + 2) ** 2, 2 * gap + 2) > 0.5
    third = np.arange(-(-gap // 3), gap)  # the longest of three is a third of the gap at least
    for a in third[have[third] & sums[gap - third]][::-1].tolist():
        if found := pair(gap - a, a):
            return a, *found
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces of it}) for each kind of sequence; all pieces are used.

    Every step uses up a length, or a kind of open sequence, so there are a few thousand kinds at most.
    """
    counts = counts.astype(np.int64).copy()
    kinds: list[tuple[int, dict[int, int]]] = []
    left = np.zeros_like(counts)
    for length in range(capacity, 0, -1):
        while counts[length] > 0:
            if length == capacity:
                kinds.append((int(counts[length]), {length: 1}))
                counts[length] = 0
                break
            counts[length] -= 1
            found = complements(counts, capacity - length)
            counts[length] += 1
            if found is None:
                left[length], counts[length] = counts[length], 0
                break
            need: dict[int, int] = {}
            for l in (length, *found):
                need[l] = need.get(l, 0) + 1
            times = min(int(counts[l]) // k for l, k in need.items())
            for l, k in need.items():
                counts[l] -= k * times
            kinds.append((times, need))
    # best fit, longest first; open sequences of one kind are moved together
    opened: dict[int, list[tuple[int, dict[int, int]]]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(times: int, kind: dict[int, int]) -> None:
        gap = capacity - sum(l * k for l, k in kind.items())
        opened.setdefault(gap, []).append((times, kind))
        gaps[gap] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                each = capacity // length
                if n // each:
                    put(n // each, {length: each})
                if n % each:
                    put(1, {length: n % each})
                break
            gap = length + int(fits[0])
            times, kind = opened[gap].pop()
            each = min(gap // length, max(1, n // times))
            used = min(times, n // each)
            if used < times:
                opened[gap].append((times - used, kind))
            gaps[gap] = bool(opened[gap])
            put(used, kind | {length: kind.get(length, 0) + each})
            n -= used * each
    kinds += [x for kinds_of in opened.values() for x in kinds_of]
    return kinds


def ranges(kinds: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from which rank on a kind of sequence takes the pieces of a length."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, kind in kinds:
        offset = 0
        for length, each in sorted(kind.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            taken[length] = first + times * each
            offset += length * each
        sequence += times
    rows.sort()
    return {k: np.asarray([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "first", "each", "sequence", "offset"))}


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    made = saved(pieces(docs, path, capacity, end))
    by_block = made.groupBy("block", "length").count()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_block.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        counts[length] = n
    rows = ranges(plan(counts, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ranked = made.join(by_block.withColumn("before", F.coalesce(before, F.lit(0))).drop("count"), ["block", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "block")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    key = rows["length"] << 44 | rows["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            nth = rank - rows["first"][i]
            sequence, offset = rows["sequence"][i] + nth // rows["each"][i], rows["offset"][i] + nth % rows["each"][i] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
