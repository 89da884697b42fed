"""Operator 8: SentencePiece encoding and decoding, exact for merge-type (BPE) models, by backtracking.

The encoder never merges pair by pair over a text. It walks the text with the longest vocabulary match at each
place (from an Aho-Corasick automaton), keeps a match only if it is compatible with the token before it (the two
strings joined, merged anew, give back the same two tokens), tries the next shorter match else, and on a dead end
steps back and marks the place in a bitfield so that it is never tried again. Every place is marked at most once, so
the time is linear in the text for tokens of bounded length.

Defined results: null and empty texts encode to the end id alone and decode to the empty string; characters that the
model lacks become byte pieces; repeated rows give equal results, each its own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm.common import chunks_of, id_and_text, table, without_collector

SPACE = "▁"
#: Pieces hold the space mark only in front, so a text can be cut before each run of marks.
SEGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
NEVER = float("inf")


#: Texts that show a normalisation other than identity, a missing dummy prefix, or spaces that the model joins or strips.
PROBES = ["", " ", "a", "  a  b ", "\ta\nb\r\n", "Ａ ﬁ ① é e\u0301", "\u00a0x\u3000y", "\U0001f600\u0000", "▁a ▁"]


class Codec:
    """Encoder and decoder of a model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, path: str, remembered: int = 400_000, longest: int = 64):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.end, self.unknown = model.eos_id(), model.unk_id()
        self.hidden = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        #: Ids that do not decode to their pieces alone.
        self.odd = {self.unknown, *self.hidden, *self.byte_of}
        usable = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in usable}
        #: A piece's place in the order of merges, by falling score.
        self.order = {self.pieces[i]: -model.get_score(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece holds the space mark behind a letter; texts cannot be cut at spaces")
        self.compatible_pairs: dict[tuple[str, str], bool] = {}
        self.remembered, self.longest = remembered, longest
        #: Segments seen of late and before; the older half goes when the newer one is full.
        self.memory: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        #: Of an id: its decimal, and the text that it decodes to.
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.spelling = [p.replace(SPACE, " ") for p in self.pieces]
        whole = [p for p in self.id_of if self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        for probe in PROBES:
            if self.encode(probe, end=False) != model.encode(probe):
                raise ValueError(f"the model does not normalise or part texts as this codec does: {probe!r}")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the definition: join the best-ranked adjacent pair, leftmost first, to the end."""
        parts, rank = list(text), self.order.get
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.compatible_pairs.get((a, b))
        if known is None:
            if len(self.compatible_pairs) > 1_000_000:
                self.compatible_pairs.clear()
            known = self.compatible_pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def tokens(self, text: str) -> list[str]:
        """Pieces of a text, characters unknown to the model as themselves."""
        n = len(text)
        at: list[list[int] | None] = [None] * n  # lengths of the matches that start at a place, rising
        for last, length in self.automaton.iter(text):
            if (found := at[last + 1 - length]) is None:
                at[last + 1 - length] = [length]
            else:
                found.append(length)
        failed = bytearray(n // 8 + 1)
        known, compatible = self.compatible_pairs, self.compatible
        out: list[str] = []
        left: list[int] = []  # for each piece taken, how many shorter matches are still untried; -1: an unknown character
        place, tries = 0, -1
        while place < n:
            found = at[place]
            if found is None:  # no piece starts here: the character stands alone, and joins with nothing
                out.append(text[place])
                left.append(-1)
                place, tries = place + 1, -1
                continue
            i = len(found) if tries < 0 else tries
            before = out[-1] if out and left[-1] >= 0 else None
            while i:
                i -= 1
                end = place + found[i]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = text[place:end]
                if before is None or ((fits := known.get((before, piece))) is None and compatible(before, piece)) or fits:
                    out.append(piece)
                    left.append(i)
                    place, tries = end, -1
                    break
            else:
                failed[place >> 3] |= 1 << (place & 7)
                place -= len(out.pop())
                tries = left.pop()
        return out

    def ids(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece in self.tokens(segment):
            known = self.id_of.get(piece)
            if known is not None:
                out.append(known)
            elif self.id_of_byte:
                out += [self.id_of_byte[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def segment(self, segment: str) -> tuple[int, str, str]:
        """Of a segment: the number of its ids, their decimals, and the text that they decode to."""
        known = self.memory.get(segment)
        if known is None:
            known = self.older.get(segment)
            if known is None:
                pieces = self.tokens(segment)
                try:
                    ids = list(map(self.id_of.__getitem__, pieces))
                    known = len(ids), " ".join(map(self.decimal.__getitem__, ids)), "".join(map(self.spelling.__getitem__, ids))
                except KeyError:  # byte pieces
                    ids = self.ids(segment)
                    known = len(ids), " ".join(map(self.decimal.__getitem__, ids)), self.spelled(ids)
            if len(segment) <= self.longest:
                if len(self.memory) >= self.remembered:
                    self.older, self.memory = self.memory, {}
                self.memory[segment] = known
        return known

    def cut(self, text: str) -> list[str]:
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str, end: bool = True) -> list[int]:
        return [i for s in self.cut(text) for i in self.ids(s)] + [self.end] * end

    def spelled(self, ids: list[int]) -> str:
        """The text of ids, the mark of the dummy prefix included, as spaces."""
        if self.odd.isdisjoint(ids):
            return "".join([self.spelling[i] for i in ids])
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.hidden:
                out.append(self.spelling[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).removeprefix(" ")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of their decimals, SHA-256 of the decoded text."""
        recent, segment = self.memory.get, self.segment
        known = [recent(s) or segment(s) for s in self.cut(text)]
        counts, decimals, spelled = zip(*known) if known else ((), (), ())
        ids = hashlib.sha256(" ".join([*decimals, str(self.end)]).encode())
        decoded = hashlib.sha256("".join(spelled).removeprefix(" ").encode("utf-8", "surrogatepass"))
        return 1 + sum(counts), ids.hexdigest(), decoded.hexdigest()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model in a Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """docs(doc_id, text) with ids array<int>, the end id last, and decoded string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in chunks_of(batches, 2_000_000):
            with without_collector():
                ids = [c.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Of each document: n_tokens, ids_sha256 and decoded_sha256, without moving the ids out of the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in chunks_of(batches, 2_000_000):
            with without_collector():  # the memory holds no cycles, and walking it again and again costs a sixth of the time
                n, ids, decoded = zip(*(c.digest(t or "") for t in batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
