"""Members of remote ZIPs as a Spark source: the index decides what is read, in tasks, by ranged requests for neighbouring members.

``format("archive")`` plans its partitions on the driver from the index of each archive named, with the filters on ``name`` that Spark hands down.
``index``, ``spans`` and ``contents`` are the same as tables, for many archives or for members that a join picks: the indexes are read
in tasks, neighbours are found by a window over the offsets, and each span is one request in one task. A server that ignores ranges is read as a stream, a member at a time.
"""

from __future__ import annotations

import importlib
import io
import json
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from quarrystone.sources import remote_archive
from quarrystone.sources.patience import Patience, Refused, Reply, http

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Bytes between members that are read rather than asked around; bytes and requests of a partition, at most (a single member may be larger).
GAP, MOST, REQUESTS = 256 * 1024, 64 << 20, 32
SCHEMA = "archive string, name string, size long, content binary"


class NoRanges(RuntimeError):
    pass


class Http:
    """Ranged reads of a URL."""

    def __init__(self, url: str, patience: Patience = Patience()):  # noqa: B008
        self.url, self.patience = url, patience

    def asked(self, method: str = "GET", **headers: str) -> Reply:
        reply = self.patience.settled(lambda: http(self.url, headers, method), self.url)
        if reply.status >= 400:
            raise Refused(self.url, reply.status)
        return reply

    def size(self) -> int:
        found = {k.lower(): v for k, v in self.asked("HEAD").headers.items()}
        return int(found["content-length"])

    def read(self, start: int, end: int) -> bytes:
        reply = self.asked(Range=f"bytes={start}-{end - 1}")
        if reply.status != 206:
            raise NoRanges(f"{self.url} sends the whole archive")
        return reply.body

    def stream(self):
        import urllib.request

        return urllib.request.urlopen(self.url, timeout=600)


class Shared:
    """Ranged reads of a file in a store that pyarrow opens: a shared folder, HDFS, an object store."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def size(self) -> int:
        return self.store.get_file_info(self.path).size

    def read(self, start: int, end: int) -> bytes:
        with self.store.open_input_file(self.path) as f:
            return f.read_at(end - start, start)

    def stream(self):
        return self.store.open_input_stream(self.path)


def opened(path: str, opener: str | None = None):
    """An object with size(), read(start, end) and stream(): of ``module:function`` if there is one, else by the path's kind."""
    if opener:
        module, _, function = opener.partition(":")
        return getattr(importlib.import_module(module), function)(path)
    return Http(path) if path.startswith(("http://", "https://")) else Shared(path)


@dataclass(frozen=True)
class Entry:
    """A member, as the index has it."""

    name: str
    offset: int
    end: int
    packed: int
    size: int
    method: int
    crc: int

    @classmethod
    def of(cls, i: zipfile.ZipInfo) -> Entry:
        return cls(i.filename, i.header_offset, i.header_offset + remote_archive.LOCAL + len(i.filename.encode()) + len(i.extra) + i.compress_size + 64, i.compress_size, i.file_size, i.compress_type, i.CRC)

    def content(self, block: bytes, start: int, read: Callable[[int, int], bytes]) -> bytes:
        """Out of the bytes from ``start`` on; what a longer local header pushes out of them is read."""
        at = self.offset - start
        head = block[at : at + remote_archive.LOCAL]
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{self.name}: no member where the index says")
        body = at + remote_archive.LOCAL + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
        raw = block[body : body + self.packed]
        if len(raw) < self.packed:
            raw += read(start + body + len(raw), start + body + self.packed)
        content = zlib.decompress(raw, -15) if self.method == zipfile.ZIP_DEFLATED else raw
        if zlib.crc32(content) != self.crc:
            raise ValueError(f"{self.name}: checksum differs")
        return content


def entries(path: str, opener: str | None = None) -> list[Entry]:
    remote = opened(path, opener)
    return [Entry.of(i) for i in remote_archive.index(remote.read, remote.size()) if not i.is_dir()]


def joined(found: list[Entry], gap: int, most: int) -> list[list[Entry]]:
    """Members of one request each: those within ``gap`` bytes of one another, while the request stays within ``most`` bytes."""
    out: list[list[Entry]] = []
    for e in sorted(found, key=lambda e: e.offset):
        if out and e.offset - out[-1][-1].end <= gap and e.end - out[-1][0].offset <= most:
            out[-1].append(e)
        else:
            out.append([e])
    return out


def matches(f: Filter) -> Callable[[str], bool] | None:
    """What a filter on the name asks; None for other filters."""
    if getattr(f, "attribute", None) != ("name",):
        return None
    if isinstance(f, EqualTo):
        return f.value.__eq__
    if isinstance(f, In):
        return frozenset(f.value).__contains__
    if isinstance(f, StringStartsWith):
        return lambda n: n.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda n: n.endswith(f.value)
    if isinstance(f, StringContains):
        return lambda n: f.value in n
    return None


@dataclass
class Requests(InputPartition):
    """Spans of one archive that a task reads, a request each; None: the whole archive as a stream, for the names that ``wanted`` has."""

    archive: str
    spans: list[list[Entry]] | None


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)
        self.filters: list[Filter] = []

    def number(self, name: str, usual: int) -> int:
        return int(self.options.get(name, usual))

    def wanted(self, name: str) -> bool:
        return all(matches(f)(name) for f in self.filters)

    def partitions(self):
        named = self.options["path"]
        out = []
        for path in json.loads(named) if named.startswith("[") else [named]:
            try:
                found = [e for e in entries(path, self.options.get("opener")) if self.wanted(e.name)]
            except NoRanges:
                out.append(Requests(path, None))
                continue
            held: list[list[Entry]] = []
            weight = 0
            for span in joined(found, self.number("gap", GAP), self.number("most", MOST)):
                size = span[-1].end - span[0].offset
                if held and (len(held) >= self.number("requests", REQUESTS) or weight + size > self.number("most", MOST)):
                    out.append(Requests(path, held))
                    held, weight = [], 0
                held.append(span)
                weight += size
            if held:
                out.append(Requests(path, held))
        return out

    def read(self, partition):
        remote = opened(partition.archive, self.options.get("opener"))
        if partition.spans is None:
            with remote.stream() as whole:
                for name, content in streamed(whole, self.wanted):
                    yield partition.archive, name, len(content), content
            return
        for span in partition.spans:
            start = span[0].offset
            block = remote.read(start, span[-1].end)
            for e in span:
                yield partition.archive, e.name, e.size, e.content(block, start, remote.read)


class PushedReader(ArchiveReader):
    def pushFilters(self, filters):
        for f in filters:
            if matches(f) is None:
                yield f  # Spark applies it
            else:
                self.filters.append(f)


class ArchiveSource(DataSource):
    """format("archive"): options ``path`` (one, or a JSON list), ``gap``, ``most``, ``requests``, ``opener`` (module:function), ``pushdown``.

    With ``pushdown`` the session has to have PUSHDOWN on; archive() sets the option as the session is.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else ArchiveReader)(self.options)


def archive(spark: SparkSession, *paths: str, **options: object) -> DataFrame:
    """archive, name, size, content of the members; filters on the name are applied to the index where the session pushes filters down."""
    spark.dataSource.register(ArchiveSource)
    pushed = spark.conf.get(PUSHDOWN, "false")
    return spark.read.format("archive").options(path=json.dumps(list(paths)), pushdown=pushed, **{k: str(v) for k, v in options.items()}).load()


#: Fixed by the format: a local header's fields, and the bit that says that sizes stand behind the member.
BEHIND = 0x8


def streamed(whole, wanted: Callable[[str], bool]) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the members wanted, read forward: memory is that of one member. The central directory ends it."""
    reader = whole if isinstance(whole, io.BufferedReader) else io.BufferedReader(Forward(whole), 1 << 20)

    def exactly(n: int) -> bytes:
        out = reader.read(n)
        if len(out) < n:
            raise ValueError("the archive breaks off")
        return out

    while (mark := reader.read(4)) == b"PK\x03\x04":
        head = exactly(remote_archive.LOCAL - 4)
        flags, method, crc, packed = (int.from_bytes(head[a:b], "little") for a, b in ((2, 4), (4, 6), (10, 14), (14, 18)))
        name = exactly(int.from_bytes(head[22:24], "little")).decode("utf-8" if flags & 0x800 else "cp437")
        extra = exactly(int.from_bytes(head[24:26], "little"))
        large = packed == 0xFFFFFFFF
        if large:  # the sizes are in the extra field
            packed = sizes_of(extra)
        take = wanted(name) and not name.endswith("/")
        parts: list[bytes] = []
        check = 0
        if method == zipfile.ZIP_DEFLATED:
            inflate, left = zlib.decompressobj(-15), None if flags & BEHIND else packed
            while not inflate.eof:
                seen = reader.peek(1) if left is None or left else b""
                if not seen:
                    raise ValueError(f"{name}: breaks off")
                seen = seen if left is None else seen[:left]
                made = inflate.decompress(seen)
                used = len(seen) - len(inflate.unused_data)
                exactly(used)
                left = None if left is None else left - used
                check = zlib.crc32(made, check)
                if take:
                    parts.append(made)
            if left:
                exactly(left)
        elif flags & BEHIND:
            raise ValueError(f"{name}: stored without its size, which only the index tells")
        else:
            while packed:
                made = exactly(min(packed, 1 << 20))
                packed -= len(made)
                check = zlib.crc32(made, check)
                if take:
                    parts.append(made)
        if flags & BEHIND:
            first = exactly(4)
            crc = int.from_bytes(exactly(4) if first == b"PK\x07\x08" else first, "little")
            exactly(16 if large else 8)
        if check != crc:
            raise ValueError(f"{name}: checksum differs")
        if take:
            yield name, b"".join(parts)
    if mark not in (b"PK\x01\x02", b"PK\x05\x06"):
        raise ValueError("no ZIP, or one that breaks off")


def sizes_of(extra: bytes) -> int:
    """The packed size in the extra field of large members."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = int.from_bytes(extra[at : at + 2], "little"), int.from_bytes(extra[at + 2 : at + 4], "little")
        if kind == 1 and n >= 16:
            return int.from_bytes(extra[at + 12 : at + 20], "little")
        at += 4 + n
    raise ValueError("a large member without its size")


class Forward(io.RawIOBase):
    """What can only be read forward, for a buffer."""

    def __init__(self, whole):
        self.whole = whole

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        part = self.whole.read(len(buffer))
        buffer[: len(part)] = part
        return len(part)


INDEX = "archive string, name string, offset long, end long, packed long, size long, method int, crc long"


def index(archives: DataFrame, opener: str | None = None) -> DataFrame:
    """INDEX of every archive named in the column ``archive``, read in tasks, an archive at a time."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = entries(path, opener)
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.int64()]
                    columns = [[path] * len(part), *([getattr(e, c) for e in part] for c in names[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    paths = archives.select(F.col("archive").cast("string")).where("archive is not null").distinct()
    return paths.repartition("archive").mapInArrow(run, INDEX)


def spans(wanted: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """The rows of an index, with ``span``: members of one archive that one request reads.

    A request starts where a gap is wider than ``gap``, and at each multiple of ``most`` bytes from there.
    """
    by = Window.partitionBy("archive").orderBy("offset")
    fresh = wanted.withColumn("fresh", F.coalesce(F.col("offset") - F.lag("end").over(by) > gap, F.lit(True)))
    run = fresh.withColumn("begins", F.last(F.when(F.col("fresh"), F.col("offset")), ignorenulls=True).over(by))
    return run.withColumn("span", F.struct("begins", F.floor((F.col("offset") - F.col("begins")) / most).alias("part"))).drop("fresh", "begins")


def contents(planned: DataFrame, opener: str | None = None) -> DataFrame:
    """archive, name, size, content of the members of spans(), a request for each span."""
    names = ["archive", "name", "offset", "end", "packed", "size", "method", "crc"]
    schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, Entry]] = []
        mark = None

        def fetched() -> Iterator[pa.RecordBatch]:
            remote = opened(held[0][0], opener)
            start = held[0][1].offset
            block = remote.read(start, max(e.end for _, e in held))
            for path, e in held:
                yield pa.RecordBatch.from_pylist([{"archive": path, "name": e.name, "size": e.size, "content": e.content(block, start, remote.read)}], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["archive"], row["span"]["begins"], row["span"]["part"])
                if held and here != mark:
                    yield from fetched()
                    held.clear()
                mark = here
                held.append((row["archive"], Entry(*(row[c] for c in names[1:]))))
        if held:
            yield from fetched()

    dealt = planned.select(*names, "span").repartition("archive", "span").sortWithinPartitions("archive", "span", "offset")
    return dealt.mapInArrow(run, SCHEMA)
