"""An adaptive limit for calls of a plug-in to an outside service, and the reading of its errors. Not relational; used inside one process."""

from __future__ import annotations

import math
import re
import threading
import time
from collections import deque

#: Bounds and window of the limit.
START, MOST, WINDOW_S, LEAST_CALLS, GOOD, CUT, FAILURES, BAD = 5, 20, 60.0, 10, 0.95, 0.3, 5, 0.855


def is_rate_limit(message: str) -> bool:
    return "429" in message or "rate_limit_exceeded" in message.lower()


def is_quota(message: str) -> bool:
    return "insufficient_quota" in message.lower() or "quota" in message.lower()


def retry_after(message: str) -> float | None:
    """Seconds of "try again in N unit", held to 0.05 to 30; None where nothing is said."""
    m = re.search(r"try again in (\d+(?:\.\d+)?)\s*(ms|s|m)\b", message, re.I)
    if not m:
        return None
    return min(30.0, max(0.05, float(m.group(1)) * {"ms": 0.001, "s": 1.0, "m": 60.0}[m.group(2).lower()]))


class AdaptiveLimit:
    """Concurrent calls allowed: one more after a good window, three tenths fewer (rounded up) on a rate limit, failures in a row or a poor window."""

    def __init__(self, start: int = START, most: int = MOST, clock=time.monotonic):
        self.limit, self.most, self.clock = start, most, clock
        self.results: deque[tuple[float, bool]] = deque()
        self.in_a_row, self.until, self.used, self.free = 0, 0.0, 0, threading.Condition()

    def _rate(self) -> float:
        now = self.clock()
        while self.results and now - self.results[0][0] > WINDOW_S:
            self.results.popleft()
        return sum(ok for _, ok in self.results) / len(self.results) if self.results else 1.0

    def _less(self) -> None:
        self.limit = max(1, self.limit - math.ceil(self.limit * CUT))
        self.results.clear()
        self.in_a_row = 0

    def report(self, ok: bool, message: str = "") -> None:
        """Take note of a call's end."""
        with self.free:
            self.results.append((self.clock(), ok))
            self.in_a_row = 0 if ok else self.in_a_row + 1
            rate = self._rate()
            if not ok and is_rate_limit(message):
                self.until = max(self.until, self.clock() + (retry_after(message) or 0.0) + 1.0)
                self._less()
            elif self.in_a_row >= FAILURES or (len(self.results) >= LEAST_CALLS and rate < BAD):
                self._less()
            elif len(self.results) >= LEAST_CALLS and rate >= GOOD and self.limit < self.most:
                self.limit += 1
                self.results.clear()
            self.free.notify_all()

    def wait(self) -> float:
        """Seconds until calls are allowed again."""
        return max(0.0, self.until - self.clock())

    def __enter__(self):
        with self.free:
            self.free.wait_for(lambda: self.used < self.limit)
            self.used += 1
        if (pause := self.wait()) > 0:
            time.sleep(pause)
        return self

    def __exit__(self, kind, error, _trace):
        with self.free:
            self.used -= 1
        self.report(kind is None, str(error or ""))
