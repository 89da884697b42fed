"""Operator 2: repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the threshold of ``length`` bytes, by most-significant-digit passes over the bytes themselves; the
groups of equal ones are exactly the repeated windows. Not every suffix of the corpus is sent, which would take thirteen times its size:

* Each window has an anchor: that of its strings of ``DIGIT`` bytes with the smallest hash. The choice depends on the window's content
  alone, so equal windows choose alike, and neighbours mostly share one.
* The first digit is the anchor's hash. Groups of one document are dropped; what is left goes on with its bytes.
* Each further pass splits the groups by the next eight bytes from the suffix's start, and drops those of one document, to depth ``length``.

Equality is that of the bytes; hashes only sort out what cannot be equal. Defined results: null and empty texts have no bytes and keep nothing
(the SHA-256 of the empty string); texts shorter than the threshold are kept whole; of equal texts the smallest id is kept; rows with the
same id do not judge one another; a null id counts as the largest id; columns other than doc_id and text are not read unless carried.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import mix64, table
from quarrystone.llm.repeats import Kernel, Parsed, Ranges, Seeds, runs, valid_starts, without_repeats

#: Bytes of a window, and of the first digit.
LENGTH, DIGIT = 50, 18
U = np.uint64
BYTES = mix64(np.arange(1, 257, dtype=U))


def byte_digits(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Eight bytes from each place on, as a number whose order is theirs."""
    data = np.frombuffer(b"".join(contents) + bytes(8), np.uint8)
    out = np.zeros(len(data) - 8, U)
    for i in range(8):
        out = out << U(8) | data[i : i + len(out)]
    return out, np.asarray([len(c) for c in contents], np.int64)


def byte_kernel(length: int = LENGTH, digit: int = DIGIT) -> Kernel:
    digit = min(digit, length)

    def parse(data: np.ndarray, starts: np.ndarray) -> Parsed:
        raw = data.tobytes()

        def content(begin: np.ndarray, end: np.ndarray) -> list[bytes]:
            return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]

        def keep(gone: np.ndarray) -> list[bytes]:
            left, total = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[starts].tolist()
            return [left[a:b] for a, b in zip(total, total[1:])]

        n, empty = len(data), np.zeros(0, np.int64)
        if n < length:
            return Parsed(starts, Seeds(empty, empty, empty, empty.astype(U)), content, keep)
        ranges = Ranges(BYTES[data])
        sums, back = ranges.sums, ranges.back
        digits = mix64((sums[digit:] - sums[:-digit]) * back[: n - digit + 1])
        low = U(n.bit_length())
        least = digits >> low << low | np.arange(len(digits), dtype=U)
        span, reach = length - digit + 1, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        anchor = (least & U((1 << int(low)) - 1)).astype(np.int64)
        first, last = runs(valid_starts(starts, length), anchor)
        doc = np.searchsorted(starts, first, side="right") - 1
        return Parsed(starts, Seeds(doc, first, last, digits[anchor[first]]), content, keep)

    return Kernel(parse, byte_digits, min(8, length))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, carried: list[str] | None = None) -> DataFrame:
    """Of each document: doc_id, n_units (bytes), n_removed, spans (byte offsets of the removed runs), kept (the bytes left)."""
    return without_repeats(docs, byte_kernel(length), length, carried)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
