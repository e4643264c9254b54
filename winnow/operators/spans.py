"""Algebra of half-open spans, partitioned by a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators.scan import Running, scan
from winnow.sources.store import discard, written


#: Places of a key that are scanned together.
WIDTH = 1 << 16


def merge(spans: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Join overlapping and touching spans; empty ones go. Columns key, span_start, span_end."""
    order, start = ["span_start", "span_end"], F.col("span_start")
    # a scan reads its rows twice, so those that are work to make are written
    full = written(spans.where("span_end > span_start").select(key, *order), "spans")
    flagged = written(scan(full, key, start, width, order, reach=Running("max", F.col("span_end"), own=False)), "spans-reach")
    discard(full)
    # an island goes by where it begins
    new = F.when(F.col("reach").isNull() | (start > F.col("reach")), start)
    island = scan(flagged, key, start, width, order, island=Running("max", new))
    out = island.groupBy(key, "island").agg(F.max("span_end").alias("span_end")).select(key, F.col("island").alias("span_start"), "span_end")
    out._winnow_path = flagged._winnow_path
    return out


def subtract(spans: DataFrame, holes: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """What is left of the merged spans outside the merged holes.

    Starts and ends of both are swept in order: a piece between two neighbouring ends is kept where
    a span is open and no hole is.
    """
    edge = lambda df, s, h: df.select(key, F.explode(F.array(F.struct(F.col("span_start").alias("at"), F.lit(s).alias("s"), F.lit(h).alias("h")), F.struct(F.col("span_end").alias("at"), F.lit(-s).alias("s"), F.lit(-h).alias("h")))).alias("e"))
    own, other = merge(spans, key, width), merge(holes, key, width)
    ends = edge(own, 1, 0).unionByName(edge(other, 0, 1))
    # several ends in one place count together
    at = written(ends.groupBy(key, F.col("e.at").alias("at")).agg(F.sum("e.s").alias("s"), F.sum("e.h").alias("h")), "spans-ends")
    discard(own, other)
    swept = scan(at, key, F.col("at"), width, ["at"], to=Running("next", F.col("at")), open=Running("sum", F.col("s")), hole=Running("sum", F.col("h")))
    left = swept.where("open > 0 AND hole = 0 AND to > at").select(key, F.col("at").alias("span_start"), F.col("to").alias("span_end"))
    out = merge(left, key, width)
    discard(at)
    return out


def meeting(left: DataFrame, right: DataFrame, key: str, own: tuple[str, str], other: tuple[str, str], width: int) -> DataFrame:
    """Pairs of one key whose closed ranges share a point.

    Ranges are dealt to the stretches of ``width`` that they touch and meet there, so ranges far apart
    in one long text do not; a pair counts where the later of the two begins.
    """
    stretch = lambda c: F.floor(F.col(c) / width)
    dealt = lambda df, a, b: df.where(F.col(a) <= F.col(b)).withColumn("_at", F.explode(F.sequence(stretch(a), stretch(b))))
    both = dealt(left, *own).join(dealt(right, *other), [key, "_at"])
    share = (F.col(own[0]) <= F.col(other[1])) & (F.col(own[1]) >= F.col(other[0]))
    return both.where(share & (F.col("_at") == F.greatest(stretch(own[0]), stretch(other[0])))).drop("_at")


def overlapping(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = 64) -> DataFrame:
    """Pairs of closed line ranges of one key that share a line.

    left: key, start_line, end_line; right: key, r_start, r_end.
    """
    return meeting(left, right, key, ("start_line", "end_line"), ("r_start", "r_end"), width)


def clip(left: DataFrame, right: DataFrame, key: str = "doc_id", width: int = 4096) -> DataFrame:
    """The parts of half-open spans (span_start, span_end) inside others (clip_start, clip_end)."""
    last = lambda df, a, b, c: df.where(F.col(a) < F.col(b)).withColumn(c, F.col(b) - 1)
    meet = meeting(last(left, "span_start", "span_end", "_own"), last(right, "clip_start", "clip_end", "_other"), key, ("span_start", "_own"), ("clip_start", "_other"), width).drop("_own", "_other")
    return meet.withColumn("part_start", F.greatest("span_start", "clip_start")).withColumn("part_end", F.least("span_end", "clip_end"))
