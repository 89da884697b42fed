"""Operator 11: packing of tokenised documents into sequences of one capacity by Karmarkar-Karp multiway differencing.

A task tokenises its documents and cuts whole sequences off those longer than the capacity. What is left of BLOCK documents is
partitioned at a time: each rest starts as a partial partition of its own, and the two partial partitions with the largest
imbalance are merged, the fullest window of one with the emptiest of the other, until one is left; its windows are nearly equal.
There are as many windows as the tokens need, and more, as many as the overflow needs, whenever a window exceeds the capacity.
As documents may be cut, the few tokens that a window lacks then come from the emptiest windows, which are given up for it, and what is left of the
last of these goes into sequences of powers of two: no sequence is padded. Nothing is shuffled; memory is that of a block.

Defined results: null and empty texts are the end id alone; a null id is returned as it is; repeated rows are documents of their own; texts of any length
are read whole; an empty table has no pieces; sequence ids hold the task's number and are not dense; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import id_and_text, table

CAPACITY, END = 2048, 1
#: Rests of documents that are partitioned together.
BLOCK = 2048
#: How a byte-level tokenizer of this kind parts texts, as its library has it built in. A fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters below this one are compared once for all.
COMPARED = 0x250
BEYOND = re.compile(f"[^\x00-{chr(COMPARED - 1)}]")
#: White space of a length that the faster library's patterns may not take.
BLANKS = re.compile(r"\s{1000}")
#: Texts that both libraries have to encode alike.
PROBES = ["", " ", "Two  words.", "don't stop, it's 12.5%!\n\nNext line \n x", "a\tb\nc\u00a0d\u3000e\x1cf", " x_y-z (q) \"r\"  ", "    DON'T'S  'll", "aaaaaaaaaaaaaaaaaaaaaaa 1234567890123 ........"]

#: A piece: number of the document in its block, its start there, its length.
Piece = tuple[int, int, int]


class ByteTokenizer:
    """Ids of a byte-level tokenizer file.

    Its table is handed to a faster library, which merges by the same ranks. Both must encode alike: the probes, and each character met in places that
    tell its class (letter, number, white space, other), as texts are parted by that alone. Texts that they may differ in are left to the file's own library.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        added = {x["content"] for x in model["added_tokens"]}
        self.added = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)")
        # a byte that prints stands for itself in the table, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        vocab = model["model"]["vocab"]
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in added}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
        self.same: dict[str, bool] = {}
        if merged != sorted(merged) or any(self.alone(t) != self.merged(t) for t in PROBES) or not all(map(self.alike, map(chr, range(COMPARED)))):
            raise ValueError("this tokenizer is not a byte-level one that merges by ranks")

    def alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def alike(self, c: str) -> bool:
        if c not in self.same:
            if len(self.same) > 1_000_000:
                self.same = {}
            probe = f"x{c}x{c}1{c}1{c}.{c}.{c} {c}  {c}"
            self.same[c] = self.alone(probe) == self.merged(probe)
        return self.same[c]

    def ids(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit numbers, little-endian."""
        if self.added.search(text) or BLANKS.search(text) or BEYOND.search(text) and not all(map(self.alike, set(BEYOND.findall(text)))):
            return self.alone(text)
        return self.merged(text)


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def differenced(lengths: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """(sum, items) of that many windows by multiway differencing, emptiest first; windows without items are left out.

    A partial partition is a sorted list of its windows that hold anything; the others, up to ``windows``, hold nothing.
    """
    # a partition's windows carry their items as nested pairs, which merge in one step
    heap = [(-n, i, [(n, i, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        # emptiest first: the j-th fullest of b meets the j-th emptiest of a, windows that hold nothing counted
        free = windows - len(a)
        cut = max(0, len(b) - free)
        met, alone = b[:cut], b[cut:]
        if met:
            joined = [(x + y, number + j, (p, q)) for j, ((x, _, p), (y, _, q)) in enumerate(zip(a, reversed(met)))]
            number += len(met)
            a = a[len(met) :]
            if len(joined) + len(alone) == 1:
                insort(a, joined[0])
            else:
                a = sorted(a + joined + alone)
        elif len(alone) == 1:
            insort(a, alone[0])
        else:
            a = sorted(a + alone)
        imbalance = a[-1][0] - (a[0][0] if len(a) == windows else 0)
        heapq.heappush(heap, (-imbalance, number, a))
        number += 1
    return [(n, items_in(p)) for n, _, p in heap[0][2]] if heap else []


def items_in(nested: tuple) -> list[int]:
    out, open_ = [], [nested]
    while open_:
        x = open_.pop()
        if len(x) == 1:
            out.append(x[0])
        else:
            open_ += (x[1], x[0])
    return out


def balanced(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of near-equal windows, fullest first, none beyond the capacity; none of the lengths is."""
    count = -(-sum(lengths) // capacity)
    while True:
        windows = differenced(lengths, count)
        over = sum(n - capacity for n, _ in windows if n > capacity)
        if not over:
            return [items for _, items in reversed(windows)]
        count += -(-over // capacity)


def filled(lengths: list[int], capacity: int) -> list[list[Piece]]:
    """Sequences that need no padding: windows, whose gaps are closed by pieces of the emptiest, and powers of two of what is left."""
    windows = balanced(lengths, capacity)
    out: list[list[Piece]] = []
    spare: list[Piece] = []  # pieces of the windows given up

    def taken(n: int) -> list[Piece]:
        """Pieces of n tokens in all."""
        got = []
        while n:
            item, start, length = spare.pop()
            got.append((item, start, min(n, length)))
            if length > n:
                spare.append((item, start + n, length - n))
            n -= got[-1][2]
        return got

    held, last = 0, len(windows)
    for k in range(len(windows)):
        if k >= last:
            break
        whole = [(i, 0, lengths[i]) for i in windows[k]]
        n = sum(lengths[i] for i in windows[k])
        gap = 0 if n & (n - 1) == 0 else capacity - n
        while held < gap and last > k + 1:
            last -= 1
            spare += [(i, 0, lengths[i]) for i in reversed(windows[last])]
            held += sum(lengths[i] for i in windows[last])
        if held < gap:  # the last window: nothing is left to close its gap
            spare += reversed(whole)
            held += n
            break
        out.append(whole + taken(gap))
        held -= gap
    while held >= capacity:
        out.append(taken(capacity))
        held -= capacity
    for bit in range(held.bit_length() - 1, -1, -1):
        if held >> bit & 1:
            out.append(taken(1 << bit))
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = tokenizer(path), array("I", [end]).tobytes()
        sequence = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        rests: list[tuple[int | None, int, bytes]] = []  # document, where its rest starts, ids of the rest

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
            out.clear()
            return batch

        def place() -> None:
            nonlocal sequence
            for pieces in filled([len(ids) // 4 for _, _, ids in rests], capacity):
                offset = 0
                for item, start, n in pieces:
                    doc, before, ids = rests[item]
                    out.append((doc, before + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), before + len(ids) // 4, sequence, offset))
                    offset += n
                sequence += 1
            rests.clear()

        for whole in batches:
            for batch in (whole.slice(i, 32) for i in range(0, whole.num_rows, 32)):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    ids = words.ids(text or "") + tail
                    n = len(ids) // 4
                    rest = n // capacity * capacity
                    for at in range(0, rest, capacity):
                        out.append((doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, sequence, 0))
                        sequence += 1
                    if rest < n:
                        rests.append((doc, rest, ids[4 * rest :]))
                if len(rests) >= BLOCK:
                    place()
                if len(out) >= 10_000:
                    yield made()
        place()
        if out:
            yield made()

    return id_and_text(docs).mapInArrow(run, ", ".join(f"{c} long" for c in schema.names))


def op11_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
