"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrystone.llm import exact_topk, license_scan, near_dedup, packing, sentencepiece_bpe, substring_dedup, suffix_dedup, toxicity, url_templates, vp_tree

P = pytest.importorskip("public_tokenizers")
WORD = rb"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, block string, key long, node string, component string, ids string, n int"


def docs_of(spark, rows):
    """documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "b", 1, "n", "c", "i", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [(i, text(rng.randint(1, 120))) for i in range(60)]
    rows += [(100 + i, f"{text(20)} {passage} {text(20)}") for i in range(8)]
    rows += [(200 + i, " ".join(w if rng.random() > 0.02 * (i % 4) else "x" for w in rows[3][1].split())) for i in range(8)]
    rows += [(300, rows[5][1]), (301, rows[5][1].upper()), (302, "a " * 300), (303, "a " * 40 + "b"), (304, "one"), (305, "one"), (306, "\n\t "), (307, ""), (308, None), (None, passage), (309, text(9000)), (5, rows[5][1])]
    rng.shuffle(rows)
    return rows


def brute_repeats(rows, units, length):
    """Marks by row index: a unit is covered by a window that starts in a row with a smaller id."""
    least: dict = {}
    big = 2**63
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - length + 1):
            w = tuple(u[k : k + length])
            least[w] = min(least.get(w, big), big if i is None else i)
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            if least[tuple(u[k : k + length])] < (big if i is None else i):
                gone[k : k + length] = [True] * length
        out.append((i, u, gone))
    return out


def spans(gone):
    edges = [i for i in range(len(gone) + 1) if (i < len(gone) and gone[i]) != (i > 0 and gone[i - 1])]
    return list(zip(edges[::2], edges[1::2]))


def by(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("operator", "length", "units", "joint"), [(suffix_dedup.suffix_dedup, 50, lambda t: list((t or "").encode()), b""), (substring_dedup.substring_dedup, 13, lambda t: re.findall(WORD, (t or "").encode()), b" ")])
def test_repeats(spark, corpus, operator, length, units, joint):
    got = operator(docs_of(spark, corpus).repartition(3), carried=["block", "n"]).collect()
    want = []
    for i, u, gone in brute_repeats(corpus, units, length):
        left = [x for x, g in zip(u, gone) if not g]
        want.append((i, len(u), sum(gone), spans(gone), bytes(left) if joint == b"" else joint.join(left)))
    assert by((r.doc_id, r.n_units, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got) == by(want)
    assert all(r.carried.block == "b" and r.carried.n == 2 for r in got)


def sets_of(rows, size):
    out = []
    for i, t in rows:
        w = re.findall(WORD, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        out.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    return out


def brute_groups(rows, size, similar=80):
    sets = sets_of(rows, size)
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= similar * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return by((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, corpus, size):
    got = near_dedup.groups(docs_of(spark, corpus), size).collect()
    assert by((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_groups(corpus, size)
    kept = near_dedup.near_dedup(docs_of(spark, corpus), size)
    assert kept.columns == docs_of(spark, corpus).columns
    assert by((r.doc_id) for r in kept.collect()) == by(i for i, _, _, k in brute_groups(corpus, size) if k)


def test_copies_in_different_components_still_meet(spark):
    """A chain: each text is like the next, the ends are not; and a far copy that is like none."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 60])) for i in range(11)] + [(50, " ".join(reversed(words)))]
    got = near_dedup.groups(docs_of(spark, rows), 2).collect()
    assert by((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_groups(rows, 2)


def morse(a, b, steps=10):
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def test_words_that_power_sums_confuse(spark):
    """The Thue-Morse word and its complement have one value in every polynomial modulo 2**64 from 1024 letters on."""
    x, y = morse("a", "b")
    common = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{common} {x}"), (2, f"{common} {y}"), (3, x), (4, y), (5, f"{common} {x}")]
    got = {r.doc_id: (r.n_units, r.n_removed) for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect()}
    assert got == {1: (13, 0), 2: (13, 0), 3: (1, 0), 4: (1, 0), 5: (13, 13)}
    got = near_dedup.groups(docs_of(spark, rows[2:4]), 2).collect()
    assert by((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (4, 4, True)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs_of(spark, rows[2:4])).collect()}
    assert got == {i: sum(g) for i, _, g in brute_repeats(rows[2:4], lambda t: list(t.encode()), 50)}


def test_the_largest_id_is_not_null(spark):
    text = " ".join(f"word{i}" for i in range(20))
    for operator in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup):
        got = operator(docs_of(spark, [(2**63 - 1, text), (None, text), (1, "x")])).collect()
        assert by((r.doc_id, r.n_removed) for r in got) == by([(2**63 - 1, 0), (None, 0), (1, 0)])


def test_links_at_the_threshold(spark):
    """Links of similarity 0.8 and a little more, and pairs just below it."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        words = [f"k{k}w{i}" for i in range(91)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: rng.choice([73, 74, 75, 80])]))]
    got = near_dedup.groups(docs_of(spark, rows), 2).collect()
    want = brute_groups(rows, 2)
    assert by((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert sum(not k for *_, k in want) > 30


def test_texts_of_one_id_link_as_one_document(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "pqr")
    rows = [(7, one), (7, two), (8, one), (9, two + " end"), (10, three)]
    got = near_dedup.groups(docs_of(spark, rows), 2).collect()
    assert by((r.doc_id, r.component_id, r.kept) for r in got) == by([(7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False), (10, 10, True)])


def test_sets_are_distinct_whatever_the_order():
    texts = [b"a b c d a b".split(), [], b"x".split(), b"a a a a".split()]
    names, cuts = near_dedup.shingle_sets(texts, 2)
    assert np.diff(cuts).tolist() == [4, 0, 1, 1] == [len(near_dedup.shingles(t, 2)) for t in texts]
    again, _ = near_dedup.shingle_sets(texts, 2, np.arange(near_dedup.SLOTS, dtype=np.uint64).astype(np.uint8) % 64)
    assert [set(names[a:b]) for a, b in zip(cuts, cuts[1:])] == [set(again[a:b]) for a, b in zip(cuts, cuts[1:])]


def test_every_bin_fills():
    for n in (1, 2, 7, 900):
        names = near_dedup.mix64(np.arange(n, dtype=np.uint64))
        assert (near_dedup.sketches(names, np.asarray([0, n])) < np.iinfo(np.uint64).max).all()


def test_sketches_estimate_similarity():
    a, b = (near_dedup.mix64(np.arange(s, s + 1000, dtype=np.uint64)) for s in (0, 250))
    s = near_dedup.sketches(np.concatenate([a, b]), np.asarray([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs_of(spark, corpus), path, capacity=256).collect()
    want = []
    for i, text in corpus:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + 256]), zlib.crc32(np.asarray(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))]
    assert by((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == by(want)
    places: dict = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 256
    assert len(places) <= 1.05 * sum(r.length for r in got) / 256 + 1  # few pieces, most of them large: no packing is without gaps


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.zeros(101, np.int64)
        counts[rng.integers(1, 101, 30)] = rng.integers(1, 50, 30)
        used = np.zeros(101, np.int64)
        for times, kind in packing.plan(counts, 100):
            assert sum(l * k for l, k in kind.items()) <= 100
            for l, k in kind.items():
                used[l] += times * k
        assert (used == counts).all()


def test_complements_respect_counts():
    counts = np.zeros(11, np.int64)
    counts[5] = 1
    assert packing.complements(counts, 10) is None
    counts[5] = 2
    assert packing.complements(counts, 10) == (5, 5)
    counts[:] = 0
    counts[[2, 3, 4]] = 1
    assert sorted(packing.complements(counts, 9)) == [2, 3, 4]


def test_words_are_tokenised_as_whole_texts():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(2)
    t, w = Tokenizer.from_file(path), packing.WordTokenizer(path)
    parts = ["a", "B", "İ", "'s", "é", "é", "́", " ", "\n", "\x1c", "\x85", "　", "1", "23", "!", "?.", "<|endoftext|>", "漢", "ß", "Σ", "don't", "_", "ǅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert w.batch(texts) == [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_plain_words_are_left_to_the_faster_library():
    """Most words of a corpus are met once: what a new one costs is most of the packing's time."""
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(8)
    t, w = Tokenizer.from_file(path), packing.WordTokenizer(path)
    parts = ["a", "th", "Ing", "É", "ñez", "ß", "ción", "Ÿ", "'s", "'LL", "'", "0", "12", "½", "º", "-", ",", "...", "(", "_", "\x01", "<|"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + ["", "a" * packing.LONG, " \n"]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]
    w.tokenizer = None  # the file's own library is not asked
    assert w.batch(texts) == want
    assert w.batch(pa.array(["a", None, *texts]).slice(1)) == [b"", *want] and w.batch(pa.array(texts).slice(7)) == want[7:] and w.batch(pa.array([], pa.string())) == []


def test_every_piece_of_the_table_is_merged_as_by_its_own_library():
    path = P.path("word_bpe_49k.json")
    w = packing.WordTokenizer(path)
    decoder = {c: bytes([b]) for b, c in byte_letters().items()}
    spelt = (b"".join(map(decoder.__getitem__, x.removesuffix("</w>"))).decode(errors="ignore") for x in w.tokenizer.get_vocab(with_added_tokens=False))
    words = sorted({x for x in spelt if x and " " not in x and not w.others.search(x)})  # words hold no blanks
    assert len(words) > 39_000
    assert w.merged(words) == w.encoded(words)


def byte_letters() -> dict[int, str]:
    """How byte-level tables write a byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def test_words_for_the_own_library():
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), random.Random(9)
    t, w = Tokenizer.from_file(path), packing.WordTokenizer(path)
    odd = ["\0", "a\0b", "<|endoftext|>", "x<|startoftext|>y", "<|EndOfText|>", "a" * (packing.LONG + 1), "e\u0301", "İ", "ΣΑΣ", "слово", "漢字", "\u1100\u1161\u11a8", "a\u00a0b", "a\x85'S", "\u212a", "Ⱥ", "ŉ", "ǰ", "don’t", "😀!"]
    texts = [" ".join(rng.choice([*odd, "plain", "Wörter,"]) for _ in range(12)) for _ in range(300)]
    assert w.batch(texts) == [np.asarray(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_sentencepiece(spark, corpus):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    odd = ["".join(rng.choice("ab the éing\n\t ▁ <0x41></s>漢字\U0001f600aaaa") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)]
    for r, (i, t) in zip(sorted(sentencepiece_bpe.encode(docs_of(spark, rows), path).collect(), key=repr), sorted(((i, sp.encode(t or "") + [2]) for i, t in rows), key=repr), strict=True):
        pass
    got = {(r.doc_id, tuple(r.ids), r.decoded) for r in sentencepiece_bpe.encode(docs_of(spark, rows), path).collect()}
    assert got == {(i, (*sp.encode(t or ""), 2), sp.decode(sp.encode(t or ""))) for i, t in rows}
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_bpe.digests(docs_of(spark, rows), path).collect()}
    assert digests == {(i, len(ids), h(" ".join(map(str, ids))), h(text)) for i, ids, text in got}


def test_sentencepiece_decodes_its_ids():
    """A decoder that spells a piece wrongly shows in the digest; very long texts are whole."""
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_bpe.Codec(path)
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rng = random.Random(6)
    long = " ".join(rng.choice(["the", "thinge", "漢", "😀", "x\n"]) for _ in range(200_000))
    for t in ("the end", long, "a" * 300_000):
        ids = sp.encode(t)
        assert c.digest(t) == (len(ids) + 1, h(" ".join(map(str, [*ids, 2]))), h(sp.decode(ids)))
    broken = sentencepiece_bpe.Codec(path)
    broken.spelling[sp.encode("end")[0]] = " ond"
    assert broken.digest("the end")[:2] == c.digest("the end")[:2] and broken.digest("the end")[2] == h("the ond") != c.digest("the end")[2]


def test_toxicity_by_held_out_labels(spark):
    """An insult is toxic only next to a group: single weights cannot tell, pairs can."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(["of", "and", "the", "to"]) + rng.choice("abc") for _ in range(8)] + ["moron"] * insult + ["zorgs"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(insult and group)))
    lab = spark.createDataFrame(labels + [(None, 0, 1), (1, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs_of(spark, [*rows, (9000, ""), (9001, None)]), lab).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert len(got) == 3002 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.accepted(docs_of(spark, rows), lab)
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == sum(r.predicted == 0 for r in got if r.doc_id < 9000)


def test_toxicity_without_labels(spark):
    got = toxicity.scored(docs_of(spark, [(1, "x")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    assert got.predicted == 0 and got.score == pytest.approx(1 / 3, abs=0.01)


def vectors_of(spark, rng, n=300, d=6):
    rows = [(i, [float(x) for x in rng.integers(-2, 3, d)], 1) for i in range(n)]
    rows += [(n + i, v, 1) for i, v in enumerate([None, [], [None] * d, [float("nan")] * d, [float("inf")] * d, [0.0] * d, [1.0, 2.0]])] + [rows[7], (None, [1.0] * d, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int")


def brute_search(rows, every, k, cost, zeros):
    good = [(i, np.asarray(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.asarray(v, float)).all() and (zeros or any(v))]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        x = min(tuple(v) for i, v in good if i == q)
        c = sorted((cost(np.asarray(x), v), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(c)]
    return out


def test_packing_finds_every_triple():
    counts = np.zeros(4097, np.int64)
    counts[400:4001:3] = 3
    assert packing.complements(counts, 2046) == (1246, 400, 400)  # the 266 longer ones below the gap leave less than 800
    counts[400] = 1
    assert packing.complements(counts, 2046) == (1243, 403, 400)
    rng = np.random.default_rng(6)
    for size in (40, 900):
        for _ in range(30):
            counts = np.where(rng.random(size) < 5 / size, rng.integers(1, 4, size), 0) if size < 100 else np.where(rng.random(size) < 0.5, 1, 0) * (np.arange(size) % 3 == 1)
            counts[0] = 0
            lengths = np.flatnonzero(counts).tolist()
            gap = int(rng.integers(size // 2, size))
            enough = lambda *ls: all(counts[l] >= ls.count(l) for l in ls)
            one, two = counts[gap] > 0, any(0 < gap - a < size and enough(a, gap - a) for a in lengths)
            three = any(0 < gap - a - b < size and enough(a, b, gap - a - b) for a in lengths for b in lengths)
            found = packing.complements(counts, gap)
            assert (found is not None) == bool(one or two or three)
            assert found is None or sum(found) == gap and enough(*found) and len(found) == (1 if one else 2 if two else 3)


def test_exact_topk_with_ties(spark):
    rows, df = vectors_of(spark, np.random.default_rng(1))
    want = [(q, r, i, -int(s)) for q, r, i, s in brute_search(rows, 50, 5, lambda a, b: -int(np.floor(256 * a) @ np.floor(256 * b)), True)]
    assert by(tuple(r) for r in exact_topk.exact_topk(df.repartition(3)).collect()) == by(want)


def test_exact_topk_with_repeated_rows_of_a_query(spark):
    good = [[float(x) for x in v] for v in np.random.default_rng(4).normal(size=(200, 4)).round(2)]
    rows = [(i, v, i) for i, v in enumerate(good)]
    for scale in (256, 1 << 28):  # products in doubles, and in 64-bit integers
        for times in (2, 4, 12):
            more = rows + [(i, good[i], -1) for i in (50, 150) for _ in range(times)]
            want = brute_search(more, 50, 5, lambda a, b: -int(np.floor(scale * a).astype(int) @ np.floor(scale * b).astype(int)), True)
            df = spark.createDataFrame(more, "vec_id long, embedding array<double>, n long").coalesce(1)
            got = [tuple(r)[:3] for r in exact_topk.exact_topk(df, scale=scale).collect()]
            assert by(got) == by(w[:3] for w in want) and len(got) == 20


def test_vp_tree_with_factor_one_is_exact(spark):
    rows, df = vectors_of(spark, np.random.default_rng(2))
    want = brute_search(rows, 100, 10, lambda a, b: float(np.sqrt(np.square(a - b).sum())), False)
    assert by(tuple(r) for r in vp_tree.nearest(df.repartition(2), factor=1.0).collect()) == by(want)


def test_vp_tree_recall(spark):
    """The query itself, on the whole table, against brute force: recall and the share of distances that the tree spares."""
    import pyarrow.parquet

    folder = "/root/testdata/sf0.1"
    t = pyarrow.parquet.read_table(f"{folder}/embeddings.parquet")
    x, ids = np.asarray(t.column("embedding").to_pylist(), float), t.column("vec_id").to_numpy()
    asks = np.flatnonzero(ids % 100 == 0)
    d = vp_tree.distances(x[asks], x)
    d[np.arange(len(asks)), asks] = np.inf
    limit = dict(zip(ids[asks].tolist(), np.sort(d, 1)[:, 9].tolist()))
    got = vp_tree.op1_vp_tree(spark, folder).collect()
    assert len(got) == 10 * len(asks)
    assert sum(r.score <= limit[r.query_id] for r in got) / len(got) >= 0.9
    # 2000 points spread evenly over a sphere of 64 dimensions: next to nothing can be spared
    assert computed(x, ids, asks)[0] < 0.98


def computed(x, ids, asks):
    """Share of all distances that the shipped factor computes in the tree that the query grows, and the recall."""
    seen, plain = [0], vp_tree.distances

    def counting(a, b):
        seen[0] += len(a) * len(b)
        return plain(a, b)

    tree, best = vp_tree.planted(x), vp_tree.Best(len(asks), 10)
    vp_tree.distances = counting
    try:
        vp_tree.searched(tree, x, ids, x[asks], ids[asks], best, vp_tree.FACTOR)
    finally:
        vp_tree.distances = plain
    d = plain(x[asks], x)
    d[np.arange(len(asks)), asks] = np.inf
    return seen[0] / (len(asks) * len(x)), float((best.cost <= np.sort(d, 1)[best.query, 9]).mean())


def test_vp_tree_prunes():
    """Points in groups, as embeddings are: most of the tree is spared; and the larger test table, where a shard is ten thousand points."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 64))
    share, recall = computed(x, np.arange(len(x)), np.arange(0, len(x), 100))
    assert share < 0.3 and recall >= 0.95
    folder = Path("/root/testdata/check_s/embeddings.parquet")
    if folder.exists():
        import pyarrow.dataset

        t = pyarrow.dataset.dataset(folder).to_table(columns=["vec_id", "embedding"])
        x, ids = np.asarray(t.column("embedding").to_pylist(), float), t.column("vec_id").to_numpy()
        share, recall = computed(x, ids, np.flatnonzero(ids % 100 == 0)[:60])
        assert share < 0.85 and recall >= 0.9


def test_vp_tree_factor_one_survives_rounding():
    rng = np.random.default_rng(8)
    for run in range(10):
        x = rng.normal(size=(2000, 1)).round(3)
        ids, best = np.arange(2000), vp_tree.Best(50, 10)
        vp_tree.searched(vp_tree.grown(x, ids, rng), x, ids, x[:50], ids[:50], best, 1.0)
        d = vp_tree.distances(x[:50], x)
        d[ids[:50], ids[:50]] = np.inf
        want = [(q, c, i) for q in range(50) for c, i in sorted(zip(d[q].tolist(), range(2000)))[:10]]
        assert list(zip(best.query.tolist(), best.cost.tolist(), best.id.tolist())) == want


def test_query_blocks_cover_all(spark):
    from quarrystone.llm.vectors import query_blocks

    _, df = vectors_of(spark, np.random.default_rng(4))
    blocks = list(query_blocks(df, 10, True, sent=200))
    assert len(blocks) > 5
    assert sorted(i for block in blocks for q, _ in block for i in q.tolist()) == [*range(0, 300, 10)]


def test_searches_in_several_blocks_and_merge_levels(spark, monkeypatch):
    from quarrystone.llm import vectors

    rows, df = vectors_of(spark, np.random.default_rng(9))
    monkeypatch.setattr(vectors, "FAN", 2)
    monkeypatch.setattr(vectors.query_blocks, "__defaults__", (100,))
    want = brute_search(rows, 50, 5, lambda a, b: -int(np.floor(256 * a) @ np.floor(256 * b)), True)
    assert by(tuple(r) for r in exact_topk.exact_topk(df.repartition(9)).collect()) == by((q, r, i, -int(s)) for q, r, i, s in want)


def test_exact_topk_of_large_components(spark):
    """Scores beyond 2**53 are exact, and those beyond 64 bits are the largest long."""
    def score(a, b):
        dot = sum((int(x) * 256 if abs(x) >= 2**53 else int(np.floor(x * 256))) * (int(y) * 256 if abs(y) >= 2**53 else int(np.floor(y * 256))) for x, y in zip(a, b))
        return max(-exact_topk.MOST, min(exact_topk.MOST, dot))

    rng = np.random.default_rng(5)
    vectors = [[1000001.0] * 64, [1000003.0] * 63 + [1000003.00390625], [1000003.0] * 64, [1000003.0] * 63 + [1000003.0078125]]
    vectors += [(rng.normal(size=64) * 10.0 ** rng.integers(0, 8)).tolist() for _ in range(60)] + [[1e300] * 64, [-1e300] * 64, [3e9] * 64]
    rows = list(enumerate(vectors))
    got = [tuple(r) for r in exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1).collect()]
    want = [(q, n + 1, i, -s) for q, v in rows for n, (s, i) in enumerate(sorted((-score(v, w), i) for i, w in rows if i != q)[:5])]
    assert by(got) == by(want)


def test_url_verdicts(spark):
    urls = ["HTTP://WWW.Example.ORG/en/12?x", "https://a.com/fr/1", "https://a.com/de/1#t", "ftp://x.net", "no scheme", None, "", "https://notexample.org/es/1", "http://org/"] + [f"https://b.com/es/{i}" for i in range(30)] + ["https://b.com/es/1"] * 3
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(None, "https://a.com/de/2", "h", "r")], "page_id long, url string, html string, rule string")
    got = {r.page_id: r for r in url_templates.url_verdicts(df).collect()}
    assert len(got) == len(urls) + 1
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("www.example.org", "/en/12", "example.org/en/1", "block")
    assert [got[i].rule for i in (1, 2, 3, 4, 7, 8)] == ["com/fr/", "com/de/", None, None, "org/", "org/"]
    assert (got[5].host, got[5].path, got[3].host, got[3].path) == ("", "", "x.net", "")
    assert len({got[i].verdict for i in range(9, len(urls))}) == 1


def brute_urls(urls, rules):
    """Verdicts by a recursion over lists of paths, from the docstring's rules alone."""
    U = url_templates

    def parts(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return host.translate(str.maketrans(U.UPPER, U.LOWER)), re.match(r"[^?#]*", rest[len(host) :])[0]

    def given(host, path):
        fits = [(len(h + p), kind) for kind, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    def pure(labelled, blocked, prior):
        if not labelled or abs(blocked / labelled - prior) <= U.Z * (prior * (1 - prior) / labelled) ** 0.5:
            return prior
        return round((blocked + U.WEIGHT * prior) / (labelled + U.WEIGHT), U.DIGITS)

    count: dict = {}
    for url in urls:
        count[parts(url)] = count.get(parts(url), 0) + 1
    label = {k: given(*k) for k in count}
    total = lambda some: (sum(count[k] for k in some if label[k]), sum(count[k] for k in some if label[k] == "block"))
    segments = {k: k[1].lstrip("/").split("/") for k in count}
    result: dict = {}
    l, b = total(count)
    root = round(b / l, U.DIGITS) if l else 0.0

    def templates(some, depth):
        by_segment: dict = {}
        for k in some:
            by_segment.setdefault(segments[k][depth] if depth < len(segments[k]) else "", []).append(k)
        rows = {s: sum(count[k] for k in ks) for s, ks in by_segment.items()}
        whole, out = sum(rows.values()), {}
        varied = len(rows) > U.VARIED and len(rows) * U.ROWS > whole
        for s, ks in by_segment.items():
            out.setdefault("*" if varied and s and rows[s] * U.VARIED < whole else s, []).extend(ks)
        return out

    def down(some, depth, priors):
        found = templates(some, depth)
        steps: dict = {}
        for t, ks in found.items():
            l, b = total(ks)
            if l:
                steps.setdefault(U.STEPS * b // l, []).append(t)
            else:
                result.update((k, priors(t)) for k in ks)
        branches: list = []
        for step in sorted(steps):
            ks = [k for t in steps[step] for k in found[t]]
            l, b = total(ks)
            if branches:
                m, c = branches[-1][1]
                p = (b + c) / (l + m)
                if abs(b / l - c / m) <= U.Z * (p * (1 - p) * (1 / l + 1 / m)) ** 0.5:
                    branches[-1][0].extend(steps[step])
                    branches[-1][1] = l, b
                    continue
            branches.append([list(steps[step]), (l, b)])
        for ts, _ in branches:
            ks = [k for t in ts for k in found[t]]
            l, b = total(ks)
            prior = round(sum(total(found[t])[0] * priors(t) for t in ts) / l, U.DIGITS)
            p = pure(l, b, prior)
            more = [k for k in ks if len(ks) > 1 and len(segments[k]) > depth + 1]
            result.update((k, p) for k in ks if k not in more)
            if more:
                down(more, depth + 1, lambda t, p=p: p)

    hosts: dict = {}
    for k in count:
        hosts.setdefault(k[0], []).append(k)
    over: dict = {}
    for ks in hosts.values():
        for t, some in templates(ks, 0).items():
            over.setdefault(t, []).extend(some)
    first = {t: pure(*total(ks), root) for t, ks in over.items()}
    for ks in hosts.values():
        down(ks, 0, first.get)
    return [label[parts(u)] or ("block" if result[parts(u)] > 0.5 else "allow") for u in urls]


def test_deep_paths_take_few_rounds(spark, monkeypatch):
    """Shared segments are gone through at once, however many, and the verdicts are those of the tree level by level."""
    rng = random.Random(4)
    deep = "/".join(f"s{i}" for i in range(1000))
    rules = [("block", "trap.net", f"/{deep}/x/"), ("allow", "trap.net", f"/{deep}/y/"), ("block", "mid.net", "/a/b/c/d/e/bad/"), ("allow", "mid.net", "/a/b/c/d/e/good/"), ("block", "one.net", "/")]
    urls = [f"http://trap.net/{deep}/{rng.choice('xyz')}/{i}" for i in range(40)] + [f"http://mid.net/a/b/c/d/e/{rng.choice(['bad', 'good', 'q'])}/{i}/f/g/h/{rng.randrange(3)}" for i in range(60)]
    urls += ["http://mid.net/a/b/c", "http://mid.net/a/b", "http://one.net/p/q/r/s", "http://one.net/p/q/r/t", "http://trap.net/" + "/".join(f"s{i}" for i in range(500))]
    rounds = []
    monkeypatch.setattr(url_templates, "level", lambda *a, f=url_templates.level: rounds.append(a[1]) or f(*a))
    got = {r.page_id: r.verdict for r in url_templates.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    deepest = sys.getrecursionlimit()
    sys.setrecursionlimit(50_000)
    try:
        assert [got[i] for i in range(len(urls))] == brute_urls(urls, rules)
    finally:
        sys.setrecursionlimit(deepest)
    assert len(rounds) < 30 and {"block", "allow"} == set(got.values())


def test_url_tree_against_brute_force(spark):
    """Paths of up to ten segments, with variable ones, frequent fixed ones among them, and rules deep down."""
    rng = random.Random(11)
    rules = [*url_templates.RULES, ("block", "deep.net", "/a/b/c/d/"), ("allow", "deep.net", "/a/b/c/x/"), ("block", "net", "/q/"), ("allow", "big.com", "/u/keep/"), ("block", "big.com", "/u/drop/")]
    urls = []
    for _ in range(2500):
        host = rng.choice(["deep.net", "big.com", "a.example.org", "b.net", "c.com", f"h{rng.randrange(40)}.net"])
        path = [rng.choice(["a", "a", "q", "de", "fr", "en", "u"])]
        while len(path) < 10 and rng.random() < 0.8:
            path.append(rng.choice(["b", "c", "d", "x", "keep", "drop", str(rng.randrange(500))]))
        if rng.random() < 0.3:
            path = ["a", "b", "c", rng.choice("dxyz"), *(rng.choice("efg") for _ in range(rng.randrange(6))), str(rng.randrange(3000))]
        urls.append(f"https://{host}/{'/'.join(path)}{rng.choice(['', '/', '?x', '#y'])}")
    urls += [None, "", "x", "http://", "http://b.net", "http://b.net//q//"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_templates.url_verdicts(df, rules).collect()}
    want = brute_urls(urls, rules)
    assert [got[i] for i in range(len(urls))] == want
    assert {w for u, w in zip(urls, want) if u and "deep.net/a/b/c/y" in u}  # decided below the third segment


def brute_licenses(rows):
    out = set()
    texts: dict = {}
    for i, t in rows:
        texts.setdefault(i, []).append(license_scan.template_words("".join(c if c.isascii() else " " for c in t or "")))
    for longest, shingles in license_scan.classes(license_scan.TEMPLATES, 5):
        for i, many in texts.items():
            for w in many:
                for start in range(0, len(w), longest):
                    there = set(license_scan.template_shingles(w[start : start + 2 * longest], 5))
                    out |= {(i, n) for n, s in shingles.items() if len(there & set(s)) / len(s) >= 0.8}
    return out


def test_license_scan(spark, corpus):
    rng = random.Random(6)
    filler = [t for _, t in corpus if t and len(t) > 50][:20]
    rows = list(corpus)
    for k, (name, text) in enumerate(sorted(license_scan.TEMPLATES.items())):
        words = text.split()
        rows += [(2000 + 3 * k, f"{rng.choice(filler)} {text.upper()} {rng.choice(filler)}"), (2001 + 3 * k, " ".join(words[: len(words) // 2])), (2002 + 3 * k, text)]
    got = {(r.doc_id, r.license) for r in license_scan.license_matches(docs_of(spark, rows)).collect()}
    assert got == brute_licenses(rows)
    assert {n for i, n in got if i and i >= 2000} == set(license_scan.TEMPLATES)


def test_license_texts_of_one_id_are_not_mixed(spark):
    whole, part = license_scan.TEMPLATES["gpl-header"], " ".join(license_scan.TEMPLATES["gpl-header"].split()[:9])
    for texts in ((whole, part), (part, whole)):
        for i in (None, 4):
            got = license_scan.license_matches(docs_of(spark, [(i, t) for t in texts]).coalesce(1)).collect()
            assert [(r.doc_id, r.containment) for r in got if r.license == "gpl-header"] == [(i, 1.0)]


def test_sql_gives_the_same_rows(spark):
    """The queries that have SQL, over the smallest tables, as the driver compares them."""
    import duckdb

    from quarrystone.llm.registry import ORACLE_SQL, QUERIES

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, folder)
        out = con.execute(sql)
        columns = [c[0] for c in out.description]
        assert sorted(columns) == sorted(df.columns), name
        assert by(tuple(r) for r in df.select(*columns).collect()) == by(out.fetchall()), name


def test_score_is_the_plain_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine(-0.3, np.arange(40), rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)))
    for _ in range(50):
        some = set(rng.choice(60, rng.integers(0, 20), replace=False).tolist())
        on = sorted(s for s in some if s < 40)
        z = m.w0 + sum(m.w[i] for i in on) + sum(float(m.v[i] @ m.v[j]) for i in on for j in on if i < j)
        assert m.score(some) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        suffix_dedup.suffix_dedup(docs), substring_dedup.substring_dedup(docs, carried=["n"]), near_dedup.groups(docs), near_dedup.near_dedup(docs), packing.pack(docs, P.path("word_bpe_49k.json")),
        sentencepiece_bpe.digests(docs, P.path("piece_bpe_32k.model")), toxicity.scored(docs, labels), toxicity.accepted(docs, labels), exact_topk.exact_topk(vectors), vp_tree.nearest(vectors),
        url_templates.url_verdicts(pages), license_scan.license_matches(docs),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, corpus, tmp_path):
    rng = random.Random(7)
    vocab = sorted({w for _, t in corpus for w in (t or "").split()})
    toxic = [(5000 + i, " ".join([*(rng.choice(vocab) for _ in range(rng.randint(5, 40))), "moron"])) for i in range(40)]
    rows = [(i, t) for i, t in corpus if i is not None and i != 5] + toxic
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i >= 5000)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first, second, third, last = (f for _, f in corpus_pipeline.STAGES)
    clean = first(spark, docs, str(tmp_path))
    passed = {r.doc_id for r in clean.collect()}
    assert passed >= {i for i, _ in rows if i < 5000} and len({i for i in passed if i >= 5000}) <= 2  # of 40
    one = second(spark, clean, str(tmp_path))
    left = [(r.doc_id, r.text) for r in clean.collect()]
    assert {r.doc_id for r in one.collect()} == {i for i, _, _, k in brute_groups(left, 5) if k}
    cut = third(spark, one, str(tmp_path))
    assert cut.columns == docs.columns
    units = lambda t: re.findall(WORD, (t or "").encode())
    mine = [(r.doc_id, r.text) for r in one.collect()]
    want = {i: (b" ".join(x for x, g in zip(u, gone) if not g).decode() if any(gone) else dict(mine)[i]) for i, u, gone in brute_repeats(mine, units, 13)}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert {r.doc_id for r in last(spark, cut, str(tmp_path)).collect()} == set(want)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(want)


WIDE = "doc_id long, text string, key long, node string, component string, block string, n int, n_chars long, carried string"


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null ids, repeated ids and rows, empty and very long texts, columns with the names that stages use inside: stage by stage against brute force, and run() as a whole."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(400)) for _ in range(n))
    passage, twin = text(60), text(50)
    rows = [(None, passage), (None, None), (None, twin), (1, f"{text(20)} {passage} {text(20)}"), (2, f"{passage} {text(30)}"), (3, twin), (4, twin), (4, text(12)), (5, None), (6, ""), (6, ""), (7, " \n"), (8, text(60_000)), (9, "é"), (10, twin.upper()), (11, text(40)), (11, text(40))]
    rows += [rows[3]]
    made = lambda rows: spark.createDataFrame([(i, t, 7, "n", "c", "b", 1, len(t or ""), "x") for i, t in rows], WIDE)
    made(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    key = lambda x: (-1 if x[0] is None else x[0], x[1] is not None, x[1] or "")
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    for stage, f in corpus_pipeline.STAGES[:-1]:
        before = got(docs)
        after = f(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.where("key <> 7 or node <> 'n' or carried <> 'x' or n <> 1").isEmpty()
        if stage == "toxicity":
            want = before  # nothing was learnt
        elif stage == "near_duplicates":
            # texts of an id are one document
            kept = {i for i, _, _, k in brute_groups([x for x in before if x[0] is not None], 5) if k}
            want = [x for x in before if x[0] is None or x[0] in kept]
            assert {x[0] for x in before} - {x[0] for x in want} == {4, 10}  # the second text of 4 goes with its id
        else:
            want = [(i, b" ".join(x for x, g in zip(u, gone) if not g).decode() if any(gone) else t) for (i, u, gone), (_, t) in zip(brute_repeats(before, lambda t: re.findall(WORD, (t or "").encode()), 13), before)]
            assert after.where("n_chars <> length(coalesce(text, ''))").isEmpty()
        assert got(after) == sorted(want, key=key)
        docs = spark.createDataFrame(after.collect(), after.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in packed if r.piece == 0) == sorted(-1 if i is None else i for i, _ in got(docs))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.ids_crc32, r.length) for r in whole) == sorted((r.ids_crc32, r.length) for r in packed)
    assert sum(r.length for r in whole if r.doc_id == 8) > 60_000


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], WIDE).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path))
        assert docs.count() == 0 and len(docs.columns) == 9
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_equal_words_get_equal_interior_symbols():
    """Recompression: what a common passage settles has the same symbols in any surroundings; runs of a word are symbols too."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        passage = rng.integers(0, 6, 40)
        sides = [rng.integers(0, 6, rng.integers(1, 30)) for _ in range(4)]
        texts = [np.concatenate([sides[0], passage, sides[1]]), np.concatenate([sides[2], np.full(5, 3), passage, sides[3]])]
        units = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        names: dict = {}
        going = substring_dedup.recompression(np.concatenate(texts), units, 2)
        try:
            asked = next(going)
            while True:
                parts = list(zip(*(a.tolist() for a in asked)))
                asked = going.send(np.asarray([names.setdefault(p, 100 + len(names)) for p in parts], np.int64))
        except StopIteration as done:
            name, left, right = done.value
        inside = []
        for base in (len(sides[0]), units[1] + len(sides[2]) + 5):
            at = (left >= base) & (right <= base + 40)
            inside.append(list(zip(name[at].tolist(), (left[at] - base).tolist(), (right[at] - base).tolist())))
        assert inside[0] == inside[1] and len(inside[0]) > 4


def test_distinct_words_of_stretches():
    """As split and a dict give them, without a step of Python for each word."""
    rng = random.Random(6)
    for n in (1, 2, 40):
        contents = [b" ".join(bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 9))) for _ in range(n)]
        known, of, units = substring_dedup.distinct_words(np.frombuffer(b"".join(contents), np.uint8), np.cumsum([len(c) for c in contents]))
        words = [w for c in contents for w in c.split(b" ")]
        assert known.to_pylist() == list(dict.fromkeys(words)) and [known[i].as_py() for i in of.tolist()] == words
        assert units.tolist() == [0, *np.cumsum([c.count(b" ") + 1 for c in contents]).tolist()]
