"""Operator 13 against brute force: whole conversations, segments, conversations over several tasks, and the cases of its docstring."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from quarrystone.llm import conversation_repair

WHITE = " \t\n\x0b\x0c\r"
ORDER = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, copies int, digest string, n int, audit string"


def after(rows):
    """Rows after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for x in out.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        left = text.strip(WHITE)
        out.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows, fault):
    """(cost, audit, output) by recursion over what is left, with up to two insertions in a place."""

    @cache
    def best(i, roles):
        """The best of the rows from i on behind output roles that end like this: '' (none), s, u or a."""
        options = [(0, "", ())] if i == len(rows) and roles in ("", "a") else []
        step = "a" if roles == "u" else "u"
        names = {"u": "user", "a": "assistant"}
        for k in (1, 2):
            made = [step, "a" if step == "u" else "u"][:k]
            if i == len(rows):
                if made[-1] == "a":
                    options.append((3 * k, "I" * k, tuple(f"{names[x]}:" for x in made)))
            else:
                options += edited(i, made[-1], 3 * k, "I" * k, tuple(f"{names[x]}:" for x in made))
        if i < len(rows):
            options += edited(i, roles, 0, "", ())
        return min(options, default=(10**9, "", ()))

    def edited(i, roles, cost, audit, made):
        _, role, text = rows[i]
        out = []

        def go(add, edit, to, row):
            c, a, r = best(i + 1, to)
            out.append((cost + add + c, audit + edit + a, made + row + r))

        go(4, "D", roles, ())
        if fault[i] not in ("b", "d"):
            late = 3 * (fault[i] == "t")
            step = "a" if roles == "u" else "u"
            if role[:1] == step or role[:1] == "s" and roles == "":
                go(late, "K", role[0], (f"{role}:{text}",))
            go(3 + late, "R", step, (f"{ {'u': 'user', 'a': 'assistant'}[step]}:{text}",))
        return out

    for i, roles in itertools.product(range(len(rows), -1, -1), ("", "s", "u", "a")):  # from the end, as Python's stack is short
        best(i, roles)
    return best(0, "")


def expected(rows):
    out = []
    for conv, x in after(rows).items():
        fault = faults(x)
        turns = [t for t, _, _ in x if t is not None]
        cost, audit, made = brute(x, fault)
        assert ORDER.fullmatch("".join(r[0] for r in made))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(x, x[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, segment=256, parts=3):
    df = spark.createDataFrame([(*r, 1, "d", 2, "a") for r in rows], SCHEMA).repartition(parts)
    out = conversation_repair.repaired(df, segment)
    assert out.dtypes == [(c, "string" if c in ("audit", "repaired_sha256") else "bigint") for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    texts = ["a.", "b!", "c", "a. ", "", " \n", "é?\n", "d", "e:f.", "g\nh", None, ".", "\x1f", "x.\x85"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "sys"]
    out = []
    for conv in range(150):
        usual = conv % 3
        for t in range(rng.randint(1, 9)):
            role = ("user", "assistant")[t % 2] if usual and rng.random() < 0.8 else rng.choice(roles)
            out.append((conv, t if rng.random() < 0.9 else rng.choice([None, t + 3, 0]), role, f"{conv} {t}." if usual and rng.random() < 0.7 else rng.choice(texts)))
    out += [(None, None, "user", "x."), (None, None, "user", "x."), (None, 3, None, None), (-5, None, "system", "s."), (-5, None, "user", "u.")]
    out += [out[7], out[7], out[40]]
    # rows that are all dropped
    lost = next((c, t) for c, t in itertools.product(range(1000, 2000), range(3)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    return [*out, (*lost, "user", "gone.")]


@pytest.mark.parametrize(("segment", "parts"), [(256, 3), (1, 2), (2, 5), (3, 1)])
def test_brute_force(spark, rows, segment, parts):
    assert got(spark, rows, segment, parts) == expected(rows)


def test_long_conversation(spark):
    """A third of all rows in one conversation, over several tasks and many segments; a role and text that recurs throughout."""
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["same.", f"t{t}.", f"t{t}", ""])) for t in range(400)] + [(100 + i, t, ("user", "assistant")[t % 2], f"{t}.") for i in range(100) for t in range(4)]
    assert got(spark, rows, segment=16) == expected(rows)


def test_search_is_least():
    """Both forms of the search agree with brute force, and the heuristic never exceeds what is left."""
    for codes in itertools.product(range(6), repeat=4):
        rows = [("user.", "assistant.", "system.", "user", "assistant", "tool.")[c] for c in codes]
        fault = ["" if r.endswith(".") else "t" for r in rows]
        want = brute([(0, r.rstrip("."), "x") for r in rows], fault)[:2]
        seen = [(False, f == "t", r[0]) for r, f in zip(rows, fault)]
        assert [*conversation_repair.search(seen, 0, whole=True).values()] == [want]
        assert conversation_repair.heuristic(seen)[0] <= want[0]
        chain = conversation_repair.Chain()
        for part in (seen[:1], [], seen[1:]):
            chain.add([(a, b, c, t) for a in range(4) for b, (c, t) in conversation_repair.edits(part, a).items()])
        assert chain.end() == want


def test_long_text(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y " * 1_000_000)]
    assert got(spark, rows) == expected(rows)


def test_empty(spark):
    assert got(spark, []) == []
