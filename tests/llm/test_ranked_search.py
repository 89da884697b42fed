"""Operator 12 against brute force: early stops, ties, nulls, repeated rows, empty tables, clashing columns, long texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, n int, terms string, score string"
ITEMS = "item_id long, text string, doc_id long, term string"
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(lower))


def brute(docs, items, k):
    found = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in found]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    for item, mine in wanted.items():
        ranked = []
        for (doc, c), size in zip(found, sizes):
            if size:
                m = 50 + 50 * size * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if c[t])
                if s > 0:
                    ranked.append((-s, doc is None, doc))
        ranked.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(ranked[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(12)
    common, rare = [f"w{i}" for i in range(20)], [f"Räre{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.8 else rare) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000, "w1-W1_w1\x00w1"), (1001, ""), (1002, None), (1003, " .,!"), (None, text(30)), (None, docs[7][1]), (7, docs[7][1]), (1004, docs[7][1]), (1005, text(20000)), (1006, "İ ÀÀ ſ")]
    docs += [(2000 + i, docs[3][1]) for i in range(80)]  # ties beyond k
    items = [(i, text(12)) for i in range(20)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w1 räre5"), (3, "w7 w7"), (3, docs[3][1]), (60, "İ àÀ ÀÀ"), (61, text(3000))]
    return docs, items


@pytest.mark.parametrize(("documents", "few", "k"), [(32_768, 1024, 50), (64, 4, 5), (1024, 60, 50)])
def test_brute_force(spark, tables, monkeypatch, documents, few, k):
    docs, items = tables
    monkeypatch.setattr(ranked_search, "DOCUMENTS", documents)
    monkeypatch.setattr(ranked_search.Shard.best, "__defaults__", (few,))
    d = spark.createDataFrame([(i, t, 9, 1, "t", "s") for i, t in docs], DOCS).repartition(3)
    got = ranked_search.ranked_search(d, spark.createDataFrame([(i, t, 4, "x") for i, t in items], ITEMS), k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_item_blocks(spark, tables, monkeypatch):
    """Several blocks of items give what one gives."""
    docs, items = tables
    monkeypatch.setattr(ranked_search.blocks_of, "__defaults__", (12_000,))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(ranked_search.blocks_of(i))) > 2
    assert sorted(map(tuple, ranked_search.ranked_search(d, i, 5).collect()), key=repr) == brute(docs, items, 5)


def test_stops_early(tables):
    """A shard leaves postings of common terms untouched, and the k best are the same."""
    rng = np.random.default_rng(1)
    n, vocabulary = 5000, 40
    weights = np.concatenate([np.full(35, 100), np.full(5, 12_000)])
    held = rng.random((n, vocabulary)) < np.concatenate([np.full(35, 0.5), np.full(5, 0.01)])
    found, sizes = np.nonzero(held)[1], held.sum(1)
    shard = ranked_search.Shard(np.arange(n), np.full(n, 100), sizes, found, rng.integers(1, 4, len(found)), weights)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, np.repeat(np.arange(n), sizes), shard.impact)
    wanted = np.arange(vocabulary)
    completed = []
    shard.completed = lambda docs, mine, f=shard.completed: completed.append(len(docs)) or f(docs, mine)
    at, scores = shard.best(wanted, 5, 0)
    assert completed and completed[0] <= ranked_search.FEW
    order = np.lexsort((at, -scores))[:5]
    want = np.lexsort((np.arange(n), -whole))[:5]
    assert at[order].tolist() == want.tolist() and scores[order].tolist() == whole[want].tolist()


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "..")], [(1, "a")])])
def test_empty(spark, docs, items):
    got = ranked_search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]
