"""Request and token budgets over sliding windows.

Windows are half-open: a request leaves the window when it is exactly as old as the window is long.
Timestamps are microseconds, so a closed range one microsecond shorter is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.limits import LIMITS


def rate_windows(attempts: DataFrame, key: str = "search", minute: int = 60, second: int = 1) -> DataFrame:
    """For each attempt, the requests of its last minute and the tokens of its last second."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    by = Window.partitionBy(key).orderBy(micros)
    return attempts.withColumn("requests", F.count(F.lit(1)).over(by.rangeBetween(-(minute * 1_000_000 - 1), 0))).withColumn("window_tokens", F.sum("tokens").over(by.rangeBetween(-(second * 1_000_000 - 1), 0)))


def request_wait(attempts: DataFrame, most: int = LIMITS.requests_per_minute, key: str = "search", minute: int = 60) -> DataFrame:
    """The time from which the next attempt may start: when the most-th last one leaves the window."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    return attempts.withColumn("free_at", F.lag("ts", most - 1).over(order) + F.expr(f"INTERVAL {minute} SECONDS"))


def request_cap(attempts: DataFrame, most: int = LIMITS.requests, key: str = "search") -> DataFrame:
    return attempts.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))).where(F.col("n") <= most).drop("n")


def cooldown(attempts: DataFrame, pause_seconds: int, key: str = "search") -> DataFrame:
    """paused: whether an attempt started before the end of all pauses that earlier 429s began."""
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col("status") == 429, F.col("ts") + F.expr(f"INTERVAL {pause_seconds} SECONDS"))
    until = F.max(end).over(order)
    return attempts.withColumn("paused", F.coalesce(F.col("ts") < until, F.lit(False)))


def corrected_tokens(attempts: DataFrame, estimate: str, reported: str) -> DataFrame:
    """A reservation is replaced by the reported usage once that is known."""
    return attempts.withColumn("tokens", F.coalesce(reported, estimate))
