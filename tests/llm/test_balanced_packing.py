"""Operator 11: ids against the tokenizer, differencing against a plain version, pieces and offsets, and the cases of its docstring."""

import heapq
import random
import zlib

import numpy as np
import pytest

from quarrystone.llm import balanced_packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def plain(lengths, windows):
    """Multiway differencing over full tuples of sums."""
    heap = [(-n, i, [0] * (windows - 1) + [n]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        c = sorted(x + y for x, y in zip(a, reversed(b)))
        heapq.heappush(heap, (c[0] - c[-1], k, c))
        k += 1
    return [n for n in heap[0][2] if n] if heap else []


@pytest.mark.parametrize("seed", range(30))
def test_differenced(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 5000), rng.randint(1, 60))  # no ties, which may be taken in any order
    for windows in (1, 2, 3, 7, 30, 100):
        got = balanced_packing.differenced(lengths, windows)
        assert sorted(i for _, items in got for i in items) == list(range(len(lengths)))
        assert all(n == sum(lengths[i] for i in items) for n, items in got)
        assert len(got) <= windows and [n for n, _ in got] == plain(lengths, windows)


@pytest.mark.parametrize("seed", range(20))
def test_filled(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 99) if seed % 2 else min(99, int(rng.expovariate(0.05)) + 1) for _ in range(rng.randint(0, 120))]
    out = balanced_packing.filled(lengths, 100)
    assert all(n == 100 or n & (n - 1) == 0 for n in (sum(p[2] for p in s) for s in out))
    parts = {}
    for s in out:
        for i, a, n in s:
            assert n > 0
            parts.setdefault(i, []).append((a, n))
    assert sorted(parts) == list(range(len(lengths)))
    for i, p in parts.items():
        p.sort()
        assert [a for a, _ in p] == np.cumsum([0] + [n for _, n in p])[:-1].tolist() and sum(n for _, n in p) == lengths[i]


def test_near_equal():
    rng = random.Random(5)
    lengths = [rng.randint(1, 2047) for _ in range(1000)]
    windows = balanced_packing.balanced(lengths, 2048)
    sums = [sum(lengths[i] for i in w) for w in windows]
    assert max(sums) <= 2048 and min(sums) > 0.95 * 2048 and len(windows) <= 1.05 * sum(lengths) / 2048


TEXTS = ["Don't  stop,\n\n it's 12.5%!", "漢字 かな　é é ᠎​١१", "x <|endoftext|> y<|endoftext|>", " " * 5000 + "x", "a" * 100_000, "7" * 30_000, "\t\r\n\x0b\x0c\x1c\x85\xa0 ", "\U0001f600\U0001f468‍\U0001f469 ok", "͸\U0003fffd x", "a\n" * 3000, "é" * 10_000 + " the end"]


def test_ids():
    from tokenizers import Tokenizer

    own, words = Tokenizer.from_file(PATH), balanced_packing.tokenizer(PATH)
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x3000), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), 32])) for _ in range(200)) for _ in range(100)]
    for t in texts:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "thon", "Ering", "and", "é"]) for _ in range(rng.randint(1, 900)))) for i in range(120)]
    rows += [(200 + i, t) for i, t in enumerate(TEXTS)] + [(300, ""), (301, None), (None, "null id"), (5, rows[5][1]), (302, "word " * 60_000)]
    d = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, length int, sequence_id int, start string").repartition(3)
    got = balanced_packing.pack(d, PATH).collect()
    want = sorted((-1 if i is None else i, np.asarray([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    # rows of one id are equal here: their pieces are told apart by how often each occurs
    starts, sequences = {}, {}
    for r in got:
        starts.setdefault((r.doc_id, r.start), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    made = []
    for i, ids in want:
        at = 0
        while at < len(ids) // 4:
            r = starts[(None if i < 0 else i, at)].pop()
            assert r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        made.append(at == len(ids) // 4)
    assert all(made) and not any(starts.values())
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert n == 2048 or n < 2048 and n & (n - 1) == 0


def test_empty(spark):
    got = balanced_packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
