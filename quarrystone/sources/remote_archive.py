"""Members of a remote ZIP by ranged reads: the index first, then the wanted members, near ones in one request."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

Ranged = Callable[[int, int], bytes]
#: Fixed by the format: bytes of a local header before its name.
LOCAL = 30


class Window(io.RawIOBase):
    """A seekable view of a remote file; each read is one ranged request."""

    def __init__(self, ranged: Ranged, size: int):
        self.ranged, self.size, self.at = ranged, size, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        end = min(self.size, self.at + len(buffer))
        part = self.ranged(self.at, end) if end > self.at else b""
        buffer[: len(part)] = part
        self.at += len(part)
        return len(part)


def index(ranged: Ranged, size: int) -> list[zipfile.ZipInfo]:
    """The archive's members, by a buffered read of its end."""
    with zipfile.ZipFile(io.BufferedReader(Window(ranged, size), 1 << 20)) as z:
        return z.infolist()


def spans(infos: list[zipfile.ZipInfo], gap: int) -> list[tuple[int, int, list[zipfile.ZipInfo]]]:
    """(start, end, members) of the requests: members in file order, joined where they lie within ``gap`` bytes of one another."""
    out: list[tuple[int, int, list[zipfile.ZipInfo]]] = []
    for i in sorted(infos, key=lambda i: i.header_offset):
        # the local header may hold a longer extra field than the index says; a little more is asked for
        end = i.header_offset + LOCAL + len(i.filename.encode()) + len(i.extra) + i.compress_size + 64
        if out and i.header_offset - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(end, out[-1][1]), [*out[-1][2], i])
        else:
            out.append((i.header_offset, end, [i]))
    return out


def members(ranged: Ranged, size: int, wanted: Callable[[str], bool], gap: int = 256 * 1024) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the members wanted by name, before anything of them is fetched."""
    for start, end, infos in spans([i for i in index(ranged, size) if not i.is_dir() and wanted(i.filename)], gap):
        block = ranged(start, min(end, size))
        for i in infos:
            at = i.header_offset - start
            head = block[at : at + LOCAL]
            body = at + LOCAL + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
            raw = block[body : body + i.compress_size]
            if len(raw) < i.compress_size:  # an extra field longer than foreseen
                raw += ranged(start + body + len(raw), start + body + i.compress_size)
            content = zlib.decompress(raw, -15) if i.compress_type == zipfile.ZIP_DEFLATED else raw
            if zlib.crc32(content) != i.CRC:
                raise ValueError(f"{i.filename}: checksum differs")
            yield i.filename, content
