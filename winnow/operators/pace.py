"""The budget of requests and tokens that a worker keeps to while it asks a model.

A search's budget is divided evenly among the tasks that ask for it, so that they need not speak to
each other; a pause that the model asked for holds for the task that was told.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from winnow.limits import LIMITS, Limits


class Pace:
    """Sliding windows of a minute (requests) and a second (tokens), for ``share`` of the limits."""

    def __init__(self, limits: Limits = LIMITS, share: float = 1.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.requests, self.tokens = max(1, int(limits.requests_per_minute * share)), limits.tokens_per_second * share
        self.now, self.sleep = now, sleep
        self.lock = threading.Lock()
        self.starts: deque[list] = deque()  # [start, tokens]
        self.until = 0.0

    def wait(self, tokens: float) -> float:
        """Seconds until an attempt of so many tokens may start."""
        t = self.now()
        while self.starts and t - self.starts[0][0] >= 60:
            self.starts.popleft()
        out = max(0.0, self.until - t)
        if len(self.starts) >= self.requests:
            out = max(out, self.starts[-self.requests][0] + 60 - t)
        recent = [s for s in self.starts if t - s[0] < 1]
        total = sum(n for _, n in recent) + tokens
        for at, n in recent:
            if total <= self.tokens:
                break
            total -= n
            out = max(out, at + 1 - t)
        return out

    def admit(self, tokens: float, deadline: float | None = None) -> list | None:
        """Wait for a place and take it; None if it would come after the deadline."""
        while True:
            with self.lock:
                left = self.wait(tokens)
                if deadline is not None and self.now() + left >= deadline:
                    return None
                if left <= 0:
                    self.starts.append([self.now(), tokens])
                    return self.starts[-1]
            self.sleep(min(left, 60.0))

    def correct(self, place: list, used: float) -> None:
        """What was reported takes the place of the estimate."""
        with self.lock:
            place[1] = used

    def pause(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, self.now() + seconds)
