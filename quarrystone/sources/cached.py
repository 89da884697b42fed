"""Answers of a JSON service kept in a folder: each is asked for once, and a 404 is an answer too.

The helpers hold one task's calls; over a cluster they run in the tasks of a source or of mapInPandas, with the cache in a shared folder.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from pathlib import Path

from quarrystone.sources.paged import RateLimiter
from quarrystone.sources.patience import Patience, Refused, Reply, http

#: What stands in the cache for a 404.
ABSENT = {"absent": True}


def written(path: Path, content: bytes) -> None:
    """The file appears whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f"{path.name}.{time.monotonic_ns()}.part")
    part.write_bytes(content)
    part.replace(path)


class CachedService:
    """get(path, params): JSON, or None for a 404. What is temporary is asked again as ``patience`` says."""

    def __init__(self, base: str, folder: str, interval: float = 0.0, headers: dict[str, str] | None = None, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep, patience: Patience = Patience()):
        self.base, self.folder, self.headers, self.opener, self.sleep, self.patience = base, Path(folder), headers or {}, opener, sleep, patience
        self.limiter = RateLimiter(interval, sleep=sleep)

    def place(self, path: str, params: dict | None) -> Path:
        name = hashlib.sha256(f"{path}?{urllib.parse.urlencode(sorted((params or {}).items()))}".encode()).hexdigest()
        return self.folder / name[:2] / f"{name}.json"

    def get(self, path: str, params: dict | None = None) -> dict | None:
        place = self.place(path, params)
        if place.exists():
            found = json.loads(place.read_text("utf-8"))
        else:
            found = self.fetched(self.base + path + ("?" + urllib.parse.urlencode(params) if params else ""))
            written(place, json.dumps(found).encode())
        return None if found == ABSENT else found

    def fetched(self, url: str) -> dict:
        def ask() -> Reply:
            self.limiter.wait()
            reply = http(url, self.headers, opener=self.opener)
            try:
                json.loads(reply.body or b"null")
            except json.JSONDecodeError:  # a body that broke off
                return Reply(0)
            return reply

        reply = self.patience.settled(ask, url, self.sleep)
        if reply.status == 404:
            return ABSENT
        if reply.status >= 400:
            raise Refused(url, reply.status)
        return json.loads(reply.body)


def lookup_all(keys: Iterable[str], place: str, bulk: Callable[[list[str]], dict[str, dict]], single: Callable[[str], dict | None] | None = None, size: int = 100) -> dict[str, dict | None]:
    """What the keys stand for: from the file of earlier answers, else by ``size`` a call, else (keys that went out of use) one by one.

    Keys that nothing knows are kept as None and not asked again; the file is saved after each call, so a stopped run goes on where it was.
    """
    file = Path(place)
    known = json.loads(file.read_text("utf-8")) if file.exists() else {}
    wanted = sorted(set(keys))
    missing = [k for k in wanted if k not in known]
    for i in range(0, len(missing), size):
        part = missing[i : i + size]
        found = bulk(part)
        known |= {k: found.get(k) or (single(k) if single else None) for k in part}
        written(file, json.dumps(known, sort_keys=True).encode())
    return {k: known[k] for k in wanted}


def downloaded(url: str, place: str, opener: Callable = urllib.request.urlopen, refresh: bool = False) -> bool:
    """Whether the file was fetched: one that is there stays, unless refresh asks for it anew."""
    file = Path(place)
    if file.exists() and not refresh:
        return False
    with opener(url, timeout=60) as answer:
        written(file, answer.read())
    return True
