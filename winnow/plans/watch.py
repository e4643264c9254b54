"""Work that ends at a deadline or when it is cancelled, in the middle of a job too."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Stopped(Exception):
    """Stands for the error of a job that a watch has ended; ``reason`` is ``cancelled`` or ``deadline``."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class Watch:
    """``seconds`` from now on (None: no end), and ``cancelled``, which is asked every so often.

    Jobs begun within ``over`` carry a tag of their own. Once the watch is due they are cancelled by it, at
    most ``every`` seconds later; jobs of other threads and sessions go on. What had been written before
    stays. A Python worker of a cancelled task ends with it (``spark.python.task.killTimeout``).
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None, cancelled: Callable[[], bool] = lambda: False, every: float = 0.05):
        self.spark, self.cancelled, self.every = spark, cancelled, every
        self.until = None if seconds is None else time.monotonic() + seconds
        self.reason: str | None = None

    def due(self) -> bool:
        if self.reason is None:
            if self.until is not None and time.monotonic() >= self.until:
                self.reason = "deadline"
            elif self.cancelled():
                self.reason = "cancelled"
        return self.reason is not None

    def check(self) -> None:
        if self.due():
            raise Stopped(self.reason)

    @contextmanager
    def over(self) -> Iterator[None]:
        """Raises ``Stopped`` at its end if the watch has cut work short, in place of the job's error."""
        self.check()
        # tags of the session are known to the thread that adds them only, those of the context to all
        context, tag, over = self.spark.sparkContext, f"winnow-{uuid.uuid4().hex}", threading.Event()

        def look() -> None:
            while not over.wait(self.every):
                if self.due():
                    context.cancelJobsWithTag(tag)  # time and again: the next job may just have begun

        watching = threading.Thread(target=look, daemon=True)
        context.addJobTag(tag)
        watching.start()
        try:
            yield
        except Exception as e:
            if self.reason is not None and not isinstance(e, Stopped):
                raise Stopped(self.reason) from e
            raise
        finally:
            over.set()
            watching.join()
            context.removeJobTag(tag)
