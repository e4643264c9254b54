"""Request and token budgets over a stream of attempts, with state per search."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from winnow.limits import LIMITS, Limits

OUTPUT = "search long, event_id long, ts timestamp, requests long, window_tokens long, wait_seconds double"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE, SECOND = 60_000_000, 1_000_000


def admit(held: list[tuple[int, int]], now: int, tokens: int, limits: Limits) -> tuple[int, int, float]:
    """(requests of the last minute, tokens of the last second, seconds to wait) with this attempt.

    ``held``: (microseconds, tokens) of earlier attempts, sorted. Windows are half-open: what is exactly
    a minute or second old has left.
    """
    minute = bisect.bisect_right(held, (now - MINUTE, math.inf))
    second = held[bisect.bisect_right(held, (now - SECOND, math.inf)) :]
    number, used, wait = len(held) - minute, sum(n for _, n in second), 0
    if number >= limits.requests_per_minute:
        wait = held[minute + number - limits.requests_per_minute][0] + MINUTE - now
    over = used + tokens - limits.tokens_per_second
    for t, n in second:
        if over <= 0:
            break
        over -= n
        wait = max(wait, t + SECOND - now)
    return number + 1, used + tokens, wait / SECOND


class Budget(StatefulProcessor):
    """Keeps a search's attempts of the last minute as a list; a timer empties it when the search is quiet."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getListState("held", "micros long, tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = sorted((int(t), int(n)) for t, n in self.held.get())
        # a search that holds nothing has no timer
        for t in list(self.handle.listTimers()) if held else []:
            self.handle.deleteTimer(t)
        frames = list(rows)
        new = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        micros = new["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        order = np.lexsort((new["event_id"].to_numpy(), micros))
        said = []
        for now, n in zip(micros[order].tolist(), new["tokens"].to_numpy()[order].tolist(), strict=True):
            said.append(admit(held, now, int(n), self.limits))
            bisect.insort(held, (now, int(n)))
        held = held[bisect.bisect_right(held, (held[-1][0] - MINUTE, math.inf)) :]
        self.held.put(held)
        self.handle.registerTimer(max(held[-1][0] // 1000 + 60_001, timerValues.getCurrentWatermarkInMs() + 1))
        requests, tokens, wait = zip(*said, strict=True)
        yield pd.DataFrame({"search": key[0], "event_id": new["event_id"].to_numpy()[order], "ts": new["ts"].to_numpy()[order], "requests": requests, "window_tokens": tokens, "wait_seconds": wait})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_budget(attempts: DataFrame, limits: Limits = LIMITS, late: str = "1 minute") -> DataFrame:
    """For each attempt of a stream (search, event_id, ts, tokens) what its windows hold and how long
    it would have had to wait. State is what the last minute holds; it goes when a search is quiet. Attempts
    later than ``late`` are dropped. The session's state store must be RocksDB (see ``decided``)."""
    keyed = attempts.select("search", "event_id", F.col("ts").cast("timestamp").alias("ts"), "tokens").withWatermark("ts", late).groupBy("search")
    return keyed.transformWithStateInPandas(Budget(limits), OUTPUT, "Append", "EventTime")


def decided(attempts: DataFrame, at: str, limits: Limits = LIMITS) -> DataFrame:
    """What ``rate_budget`` says of all attempts that a stream has now, as a table under ``at``.

    Progress, state and results are kept there: a run that died goes on from its checkpoint, a second
    run takes only what is new, and the table holds each attempt once.
    """
    conf, before = attempts.sparkSession.conf, attempts.sparkSession.conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        write = rate_budget(attempts, limits).writeStream.format("parquet").option("path", f"{at}/decided").option("checkpointLocation", f"{at}/checkpoint")
        write.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE, before)
    return attempts.sparkSession.read.schema(OUTPUT).parquet(f"{at}/decided")
