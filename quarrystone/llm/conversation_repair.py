"""Operator 13: the cheapest repair of each damaged conversation, by A* on its edit lattice.

A node of the lattice is (rows consumed, state of the role order); edges keep, rerole or delete the next row, or insert one before it.
Nodes leave the queue by (cost so far plus heuristic, audit), where the heuristic is the suffix sum of the mandatory deletions and of
the charges that each truncated row costs either way. It never exceeds what is left and never falls by more than an edge costs, so the first visit of a node is its
cheapest with the least audit, and so is the first end met.

The search sees rows without texts: role initial, fault, SHA-256 of role and text. Repeats of a row are found by one aggregate of its digests. The lean rows are dealt
by ranges of (conversation, turn), so that a long conversation lies in many tasks; where it goes beyond a task or SEGMENT rows, each segment is searched from
each of the four states to each, and a chain of these few results gives the whole. Chaining keeps the least audit, as segments end with a row's own edit:
no two audits up to there are prefixes of one another, and their order decides. At last the texts meet the audits in the order of the conversation and
are hashed as a stream: SHA-256 has no parallel form, but nothing but the audit is held.

Defined results: nulls are one space wherever they are joined or hashed, a null conv_id is a conversation of its own, and null turns come first; rows of one turn come in
the order of the SHA-256 of their role and text; repeated rows are rows; a conversation whose rows are all dropped, has zeros and an empty audit; an empty table gives none;
texts and conversations are of any length; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import released, stored, table, text_batches

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: Rows that are searched at once.
SEGMENT = 256
BLANK, WHITE = "", " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. What a user or assistant row makes of each; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: A row as the search sees it: to be deleted, truncated, role initial.
Row = tuple[bool, bool, str]


def kept(state: int, initial: str) -> int | None:
    """The state after a row of this role initial, if it may stand there."""
    if initial == "s":
        return SYSTEM if state == START else None
    return NEXT[state] if initial == ("a" if state == USER else "u") else None


def heuristic(rows: list[Row]) -> list[int]:
    """What the rows from each on cost at least."""
    out = [0]
    for must, short, _ in reversed(rows):
        out.append(out[-1] + (DELETE if must else min(DELETE, CUT_SHORT) if short else 0))
    return out[::-1]


def search(rows: list[Row], start: int, whole: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) by the state in which the rows end. whole: only the best end; else all that can be reached, and nothing is inserted behind the last row."""
    least, n = heuristic(rows), len(rows)
    queue = [(least[0], "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = f - least[i]
        if i == n:
            if not whole:
                found[state] = (cost, audit)
                continue
            if state in ENDS:
                return {state: (cost, audit)}
        if (i, NEXT[state]) not in done:
            heapq.heappush(queue, (f + INSERT, audit + "I", i, NEXT[state]))
        if i == n:
            continue
        must, short, initial = rows[i]
        cost += least[i + 1]
        heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
        if not must:
            extra = CUT_SHORT if short else 0
            to = kept(state, initial)
            if to is not None:
                heapq.heappush(queue, (cost + KEEP + extra, audit + "K", i + 1, to))
            heapq.heappush(queue, (cost + REROLE + extra, audit + "R", i + 1, NEXT[state]))
    return found


def edits(rows: list[Row], start: int) -> dict[int, tuple[int, str]]:
    """search() over a segment: an insertion belongs to the row behind it, so none stands at the end."""
    if not rows:
        return {start: (0, "")}
    return search(rows, start, whole=False)


class Chain:
    """The cheapest edits of the segments so far, by state; audits are chains of their segments' audits."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, int, tuple]] = {START: (0, 0, ())}  # cost, place among the audits, audit

    def add(self, moves: list[tuple[int, int, int, str]]) -> None:
        options: dict[int, tuple[int, int, str, tuple]] = {}
        for a, b, cost, audit in moves:
            if a in self.best:
                before, place, chain = self.best[a]
                option = (before + cost, place, audit, chain)
                if b not in options or option[:3] < options[b][:3]:
                    options[b] = option
        order = {x: i for i, x in enumerate(sorted({(place, audit) for _, place, audit, _ in options.values()}))}
        self.best = {b: (cost, order[place, audit], (chain, audit)) for b, (cost, place, audit, chain) in options.items()}

    def end(self) -> tuple[int, str]:
        """Cost and audit of the whole, with what has to be inserted at the end."""
        options = []
        for state, (cost, place, chain) in self.best.items():
            tail = ""
            while state not in ENDS:
                state, tail = NEXT[state], tail + "I"
            options.append((cost + INSERT * len(tail), place, tail, chain))
        cost, _, tail, chain = min(options, key=lambda x: x[:3])
        parts = [tail]
        while chain:
            chain, audit = chain
            parts.append(audit)
        return cost, "".join(reversed(parts))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 for a dropped row) of the rows after damage."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_digest(rows: DataFrame) -> DataFrame:
    """And the SHA-256 of role and text, which orders the rows of a turn; null for a dropped row."""
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    return rows.withColumn("digest", F.when(F.col("copies") > 0, F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256))))


def lean(rows: DataFrame) -> DataFrame:
    """The rows without texts, equal rows of a turn as one: conv_id, turn, digest, initial, blank, short, copies, and whether the row occurs at an earlier turn."""
    left = F.rtrim("text", F.lit(WHITE))
    marked = rows.select(
        "conv_id", "turn", "digest", "copies", F.when(F.col("copies") > 0, F.substring("role", 1, 1)).alias("initial"),
        (left == "").alias("blank"), (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("short"),
    )
    counted = marked.groupBy("conv_id", "turn", "digest", "initial").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("short").alias("short"))
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))  # nulls first
    first = marked.where("copies > 0").groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("met")).agg(F.min(turn).alias("first"))
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("met")), "left")
    return joined.select("conv_id", "turn", "digest", "initial", "copies", "blank", "short", F.coalesce(turn > F.col("first"), F.lit(False)).alias("again"))


MOVES = "array<struct<a:int,b:int,cost:long,audit:string>>"
PIECE = f"conv_id long, whole boolean, first_turn long, first_digest binary, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, moves {MOVES}"
SUMS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


class Piece:
    """Rows of one conversation that lie together, and what is counted over them."""

    def __init__(self, conv: int | None, turn: int | None, digest: bytes | None, seq: int):
        self.row: dict = dict.fromkeys(SUMS, 0) | {"conv_id": conv, "first_turn": turn, "first_digest": digest, "seq": seq, "first": None, "last": None, "least": None, "most": None}
        self.rows: list[Row] = []

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, short: bool) -> None:
        x = self.row
        if turn is not None and turn != x["most"]:
            x["turns"] += 1
            x["least"] = turn if x["least"] is None else x["least"]
            x["most"] = turn
        if x["last"] is None:
            x["first"] = initial
        else:
            x["illegal"] += x["last"] + initial not in LEGAL
        x["last"] = initial
        x["n"] += 1
        x["blank"] += blank
        x["duplicate"] += duplicate and not blank
        short = short and not blank and not duplicate
        x["truncated"] += short
        self.rows.append((blank or duplicate, short, initial))

    def made(self, whole: bool) -> dict:
        if whole:
            moves = [{"a": START, "b": b, "cost": cost, "audit": audit} for b, (cost, audit) in search(self.rows, START, whole=True).items()]
        else:
            moves = [{"a": a, "b": b, "cost": cost, "audit": audit} for a in range(4) for b, (cost, audit) in edits(self.rows, a).items()]
        return self.row | {"whole": whole, "moves": moves}


def pieces(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """What the search found for each whole conversation, or for each segment of those that are longer or go beyond a task."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("whole", pa.bool_()), ("first_turn", pa.int64()), ("first_digest", pa.binary()), ("seq", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
        ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()),
        ("moves", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        piece, others, seq = None, False, 0  # others: the task has seen a conversation before this one
        for batch in batches:
            for conv, turn, digest, initial, copies, blank, short, again in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is not None and piece.row["conv_id"] != conv:
                    yield piece.made(whole=others and not seq)
                    piece, others, seq = None, True, 0
                if piece is None:
                    piece = Piece(conv, turn, digest, seq)
                for k in range(copies):
                    if len(piece.rows) >= segment:
                        yield piece.made(whole=False)
                        seq += 1
                        piece = Piece(conv, turn, digest, seq)
                    piece.add(turn, initial, blank, again or k > 0, short)
        if piece is not None:
            yield piece.made(whole=False)  # it may go on in the next task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in found(batches):
            held.append(row)
            if len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest", "initial")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, PIECE)


JUDGED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def judged(found: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation."""
    whole = found.where("whole").select(
        "conv_id", F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("moves")[0]["cost"].alias("cost"), F.col("moves")[0]["audit"].alias("audit")
    )
    names = [c.split()[0] for c in JUDGED.split(", ")]
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, total = None, None

        def made() -> pa.RecordBatch:
            cost, audit = chain.end()
            gaps = 0 if total["least"] is None else total["most"] - total["least"] + 1 - total["turns"]
            return pa.RecordBatch.from_pylist([total | {"gaps": gaps, "cost": cost, "audit": audit}], schema=schema)

        for batch in batches:
            for x in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                if chain is not None and total["conv_id"] != x["conv_id"]:
                    yield made()
                    chain = None
                if chain is None:
                    chain, total = Chain(), dict.fromkeys(SUMS, 0) | {"conv_id": x["conv_id"], "last": None, "least": None, "most": None}
                for c in SUMS:
                    total[c] += x[c]
                if x["n"]:
                    total["illegal"] += total["last"] is not None and total["last"] + x["first"] not in LEGAL
                    total["last"] = x["last"]
                if x["least"] is not None:
                    total["turns"] -= total["most"] == x["least"]
                    total["least"] = x["least"] if total["least"] is None else total["least"]
                    total["most"] = x["most"]
                chain.add([(m["a"], m["b"], m["cost"], m["audit"]) for m in x["moves"]])
        if chain is not None:
            yield made()

    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "first_turn", "first_digest", "seq")]
    parts = found.where("not whole").repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(run, JUDGED)
    return whole.unionByName(parts)


def hashed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The audits with the SHA-256 of each repaired conversation: its rows follow its audit in one sorted run."""
    names = [c.split()[0] for c in JUDGED.split(", ")]
    both = audits.withColumns({"turn": F.lit(None).cast("long"), "digest": F.lit(None).cast("binary"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "copies": F.lit(-1).cast("long")}).unionByName(
        rows.where("copies > 0").select("conv_id", *(F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in names[1:]), "turn", "digest", "role", "text", "copies")
    )
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in names] + [("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, audit, at, state, digest, written = None, "", 0, START, None, False

        def out(role: str, text: str) -> None:
            nonlocal written
            digest.update(f"{chr(10) if written else ''}{role}:{text}".encode())
            written = True

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                out(NAMES[state], "")
                at += 1

        def made() -> dict:
            inserted()
            return head | {"repaired_sha256": digest.hexdigest()}

        for batch in batches:
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            heads, rest = columns[: len(names)], columns[len(names) :]
            for i, (turn, _, role, text, copies) in enumerate(zip(*rest)):
                if copies < 0:
                    if head is not None:
                        done.append(made())
                    head = {c: heads[j][i] for j, c in enumerate(names)}
                    audit, at, state, digest, written = head["audit"], 0, START, hashlib.sha256(), False
                    continue
                for _ in range(copies):
                    inserted()
                    edit, at = audit[at], at + 1
                    if edit == "K":
                        state = kept(state, role[:1])
                        out(role, text)
                    elif edit == "R":
                        state = NEXT[state]
                        out(NAMES[state], text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if head is not None:
            yield pa.RecordBatch.from_pylist([made()], schema=schema)

    order = [F.col("conv_id").asc_nulls_first(), F.least("copies", F.lit(0)), *(F.col(c).asc_nulls_first() for c in ("turn", "digest"))]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"{JUDGED}, repaired_sha256 string")


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    text_batches(conversations.sparkSession)
    rows = with_digest(damaged(conversations))
    seen = stored(lean(rows))
    found = stored(pieces(seen, segment))
    out = stored(hashed(rows, judged(found)))
    released(seen, found)
    return out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations
), c as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda x: ascii(x)::bigint)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda y, z: xor(y >> 1, case when y & 1 = 1 then 3988292384::bigint else 0 end))), 4294967295::bigint) % 20 as kind from o
), d as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from c
  cross join (select unnest([1, 2]) as copy) where kind <> 0 and (copy = 1 or kind = 3)
), r as (
  select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || ':' || text)) as i from d
), f as (
  select *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as left_, row_number() over (partition by conv_id, role, text order by i) > 1 as again, lag(role) over (partition by conv_id order by i) as before from r
), m as (
  select conv_id, i, turn, role, text, left_ = '' as blank, left_ <> '' and again as duplicate, left_ <> '' and not again and right(left_, 1) not in ('.', '!', '?') as truncated,
    left(role, 1) as ini, before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au') as illegal from f
), s as (
  select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (illegal) as illegal, max(i) as n from m group by conv_id
), ins(a, b, cost, audit, rep) as (values
  (0, 0, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'), (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 3, 'I', chr(10) || 'user:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, 0, '', ''), (2, 3, 3, 'I', chr(10) || 'assistant:'), (2, 2, 6, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', chr(10) || 'user:'), (3, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), ed(edit, a, ini, b) as (
  select 'D', a, '*', a from (select unnest([0, 1, 2, 3]) as a)
  union all (values ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 3, 'u', 2), ('K', 2, 'a', 3), ('R', 0, '*', 2), ('R', 1, '*', 2), ('R', 3, '*', 2), ('R', 2, '*', 3))
), w as (
  select conv_id, cast(0 as bigint) as i, 0 as state, {'cost': cast(0 as bigint), 'audit': '', 'rep': ''} as p from s
  union all
  select w.conv_id, m.i, ed.b as state, min({'cost': cast(p.cost + ins.cost + case edit when 'D' then 4 when 'K' then 0 else 3 end + case when edit <> 'D' and truncated then 3 else 0 end as bigint), 'audit': p.audit || ins.audit || edit,
      'rep': p.rep || ins.rep || case edit when 'D' then '' when 'K' then chr(10) || role || ':' || text else chr(10) || case ed.b when 2 then 'user' else 'assistant' end || ':' || text end}) as p
  from w join m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1 join ins on ins.a = w.state join ed on ed.a = ins.b and ed.ini in ('*', m.ini) and (edit = 'D' or not (blank or duplicate))
  group by w.conv_id, m.i, ed.b
), e as (
  select w.conv_id, min({'cost': cast(p.cost + ins.cost as bigint), 'audit': p.audit || ins.audit, 'rep': p.rep || ins.rep}) as p
  from w join s on s.conv_id is not distinct from w.conv_id and s.n = w.i join ins on ins.a = w.state and ins.b in (0, 3) group by w.conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(p.cost, 0) as cost, coalesce(p.audit, '') as audit,
  sha256(coalesce(substr(p.rep, 2), '')) as repaired_sha256
from (select distinct conv_id from o) o left join s on s.conv_id is not distinct from o.conv_id left join e on e.conv_id is not distinct from o.conv_id
"""
