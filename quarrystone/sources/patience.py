"""When to ask a service again, and how long to wait: a policy that callers are given, apart from how a request is made."""

from __future__ import annotations

import email.utils
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Reply:
    """What a service said; status 0: nothing at all."""

    status: int
    headers: Mapping[str, str] = field(default_factory=dict)
    body: bytes = b""


class Unanswered(RuntimeError):
    pass


class Refused(RuntimeError):
    def __init__(self, what: str, status: int):
        super().__init__(f"{what}: status {status}")
        self.status = status


@dataclass(frozen=True)
class Patience:
    """Pauses that grow by ``growth`` from ``first`` up to ``most``, each spread by up to ``jitter`` of it, so that tasks do not ask in step."""

    tries: int = 8
    first: float = 1.5
    growth: float = 1.8
    most: float = 120.0
    jitter: float = 0.25
    #: The longest pause that a service may ask for.
    longest: float = 600.0

    def temporary(self, status: int) -> bool:
        return status in (0, 408, 425, 429) or status >= 500

    def asked(self, reply: Reply, now: float) -> float:
        """Seconds that the reply asks for, by number or by date; 0 if it does not."""
        said = {k.lower(): v for k, v in reply.headers.items()}.get("retry-after", "").strip()
        if said.isdigit():
            return min(float(said), self.longest)
        when = email.utils.parsedate_to_datetime(said).timestamp() if said and "," in said else now
        return min(max(0.0, when - now), self.longest)

    def pauses(self, seed: object) -> Iterator[float]:
        """A pause before each try but the first; the same for the same seed."""
        spread = random.Random(str(seed))
        for k in range(self.tries - 1):
            yield min(self.most, self.first * self.growth**k) * (1 + self.jitter * spread.random())

    def settled(self, ask: Callable[[], Reply], what: str, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time) -> Reply:
        """The first reply that is not a temporary one."""
        reply = ask()
        for pause in self.pauses(what):
            if not self.temporary(reply.status):
                return reply
            sleep(max(pause, self.asked(reply, clock())))
            reply = ask()
        if self.temporary(reply.status):
            raise Unanswered(f"{what}: no answer in {self.tries} tries, the last with status {reply.status}")
        return reply


def http(url: str, headers: Mapping[str, str] | None = None, method: str = "GET", opener: Callable = urllib.request.urlopen, timeout: float = 60) -> Reply:
    """One request; every outcome is a reply."""
    try:
        with opener(urllib.request.Request(url, headers=dict(headers or {}), method=method), timeout=timeout) as answer:
            return Reply(getattr(answer, "status", 200), dict(getattr(answer, "headers", {}) or {}), answer.read())
    except urllib.error.HTTPError as e:
        return Reply(e.code, dict(e.headers or {}))
    except (urllib.error.URLError, TimeoutError, ConnectionError):
        return Reply(0)
