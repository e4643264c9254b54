"""Lines of texts with their byte spans. Lines end at LF only and are numbered from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.limits import LIMITS, Limits
from winnow.operators.scan import Running, scan
from winnow.operators.spans import meeting, merge
from winnow.sources.store import written


#: Lines, and bytes of a text, that are scanned together: a long text is many such stretches.
STRETCH_LINES, STRETCH_BYTES = 8192, 1 << 18
#: Bytes of a text up to which its lines are counted in one task.
LONG_BYTES = 1 << 20


def line_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no, line, byte_start, byte_end (with the LF, clamped to the text's length)."""
    size = F.octet_length(text).cast("long")
    split = lambda df: df.select(key, size.alias("size"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    bytes_ = F.octet_length("line") + 1
    ahead = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # short texts are one stretch each: a window does
    short = split(docs.where(size <= LONG_BYTES)).withColumn("end", F.sum(bytes_).over(ahead))
    rows = short.unionByName(scan(split(docs.where(size > LONG_BYTES)), key, F.col("i"), STRETCH_LINES, ["i"], end=Running("sum", bytes_)))
    end = F.col("end").cast("long")
    return rows.select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line", (end - F.octet_length("line") - 1).alias("byte_start"), F.least(end, F.col("size")).alias("byte_end"))


def line_at(lines: DataFrame, points: DataFrame, key: str = "doc_id") -> DataFrame:
    """The line of each point (key, byte): the last one that starts at or before it."""
    # starts and points in one order: a point's line is the last that began
    starts = lines.select(key, F.col("byte_start").alias("at"), F.lit(0).alias("asked"), F.col("line_no").alias("began"))
    asked = points.select(key, F.col("byte").alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("long").alias("began")).distinct()
    swept = scan(starts.unionByName(asked), key, F.col("at"), STRETCH_BYTES, ["at", "asked", "began"], line_no=Running("max", F.col("began")))
    return swept.where("asked = 1 AND line_no IS NOT NULL").select(key, F.col("at").alias("byte"), "line_no")


def lines_text(text: Column, first: int, last: int) -> Column:
    """Lines first..last without the final LF, unless that LF ends the text."""
    parts = F.split(text, "\n", -1)
    n = F.size(parts)
    body = F.array_join(F.slice(parts, first, last - first + 1), "\n")
    ends = (n == last + 1) & (F.element_at(parts, -1) == "")
    return F.when(n >= first, F.when(ends, F.concat(body, F.lit("\n"))).otherwise(body))


def blocks(ranges: DataFrame, size: int = LIMITS.block_lines) -> DataFrame:
    """Rows with start_line, end_line cut into blocks of ``size`` lines."""
    starts = ranges.withColumn("block_start", F.explode(F.sequence(F.col("start_line"), F.col("end_line"), F.lit(size).cast("long"))))
    return starts.withColumn("block_end", F.least(F.col("block_start") + size - 1, F.col("end_line")))


def excerpts(lines: DataFrame, ranges: DataFrame, key: str = "doc_id", limits: Limits = LIMITS) -> DataFrame:
    """key, span_start, span_end: the excerpts around ranges of lines, as byte spans.

    lines: key, line_no, byte_start, byte_end, and kind ("comment", "blank" or anything else);
    ranges: key, start_line, end_line, within the file. A range's window takes the lines around it and then
    every comment that it overlaps or that only blank lines part from it, over and over. It needs no
    repetition: the comments that reach each other over blank lines are one bridge, and lie in one run of
    comment and blank lines. A window that meets or adjoins the run gets the whole bridge; beyond it
    stand other lines, so nothing else comes into reach. Grown windows are joined where they overlap
    or touch.
    """
    count = scan(lines.select(key, "line_no", "kind"), key, F.col("line_no"), STRETCH_LINES, ["line_no"], run=Running("sum", F.when(F.col("kind").isin("comment", "blank"), 0).otherwise(1)))
    comment = F.when(F.col("kind") == "comment", F.col("line_no"))
    runs = count.where("kind IN ('comment', 'blank')").groupBy(key, "run").agg(F.min("line_no").alias("run_start"), F.max("line_no").alias("run_end"), F.min(comment).alias("bridge_start"), F.max(comment).alias("bridge_end"))
    runs = runs.where("bridge_start IS NOT NULL").drop("run")
    last = lines.groupBy(key).agg(F.max("line_no").alias("last"))
    near = windows(ranges.select(key, "start_line", "end_line"), last, key, limits).select(key, "window_start", "window_end").distinct()
    near = written(near.select("*", (F.col("window_start") - 1).alias("a"), (F.col("window_end") + 1).alias("z")), "excerpts-windows")
    met = meeting(near, runs, key, ("a", "z"), ("run_start", "run_end"), STRETCH_LINES)
    met = met.groupBy(key, "window_start", "window_end").agg(F.min("bridge_start").alias("b"), F.max("bridge_end").alias("e"))
    grown = met.select(key, F.least("window_start", "b").alias("first"), F.greatest("window_end", "e").alias("final"))
    # windows that meet no run stay as they are
    same = near.join(met, [key, "window_start", "window_end"], "left_anti").select(key, F.col("window_start").alias("first"), F.col("window_end").alias("final"))
    both = grown.union(same).distinct()
    starts = lines.select(key, F.col("line_no").alias("first"), F.col("byte_start").alias("span_start"))
    ends = lines.select(key, F.col("line_no").alias("final"), F.col("byte_end").alias("span_end"))
    return merge(both.join(starts, [key, "first"]).join(ends, [key, "final"]), key)


def hash_comments(lines: DataFrame) -> DataFrame:
    return lines.where(F.ltrim("line").startswith("#"))


def windows(ranges: DataFrame, last: DataFrame, key: str = "doc_id", limits: Limits = LIMITS) -> DataFrame:
    """Each range with the lines around it, within the file."""
    near = ranges.join(last, key)
    return near.withColumn("window_start", F.greatest(F.col("start_line") - limits.window_lines, F.lit(1).cast("long"))).withColumn("window_end", F.least(F.col("end_line") + limits.window_lines, F.col("last")))
