"""Greedy cuts of the ordered rows of a key, without walking along them.

Where a batch would end depends on where it began, so the cuts of a key seem one long walk. But where the
next batch begins if one began at a row can be said of every row by itself, from running sums. That is a
table of successors; the real beginnings are what the first row reaches in it. They are marked by
pointer doubling: in each round the rows reached so far reach on by the jumps, and each jump becomes two of
itself, so a key of n batches takes log2(n) rounds, each a join on (key, row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.operators.scan import Running, numbered, scan
from winnow.sources.store import discard, written

#: Rows that are scanned together.
ROWS = 4096


def cuts(df: DataFrame, keys: list[str], order: list[str], output: str, most_items: int, most_bytes: int, start: Column, end: Column, total: Column) -> DataFrame:
    """Add the long column ``output``, the batch's number within its key.

    A batch that begins at a row holds at most ``most_items`` rows, and those whose ``end`` is at most
    ``most_bytes`` beyond its ``start``; its first row is always in it. Both are of columns of ``df`` and
    ``total``'s running sum ``sum``, and neither falls along the order, which must tell a key's rows apart.
    """
    rows = numbered(df.select(F.struct(*keys).alias("key"), F.struct(*order).alias("at"), total.alias("size"), F.struct(*df.columns).alias("row")), "key", "at")
    placed = scan(rows, "key", F.col("seq"), ROWS, ["seq"], n=Running("sum", F.lit(1)), sum=Running("sum", F.col("size")))
    placed = written(placed.select("key", "seq", "n", "row", start.cast("long").alias("start"), end.cast("long").alias("end")), "cuts-placed")
    discard(rows)
    # the last row within reach of each row's start: ends and reaches in one order
    ends = placed.select("key", F.col("end").alias("x"), F.lit(0).alias("asked"), "n")
    asked = placed.select("key", (F.col("start") + most_bytes).alias("x"), F.lit(1).alias("asked"), F.col("n").alias("of"))
    swept = scan(ends.unionByName(asked, allowMissingColumns=True), "key", F.col("x"), max(most_bytes, 1), ["x", "asked", "n"], held=Running("max", F.col("n")))
    to = F.greatest(F.least(F.col("of") + most_items, F.coalesce("held", F.lit(0)) + 1), F.col("of") + 1)
    jumps = swept.where("asked = 1").select("key", F.col("of").alias("n"), to.alias("to"))
    # the last beginnings have no successor
    jumps = written(jumps.join(placed.select("key", F.col("n").alias("to")), ["key", "to"], "left_semi").select("key", "n", "to"), "cuts-jumps")
    reached = placed.where("n = 1").select("key", "n")
    while True:
        more = written(jumps.join(reached, ["key", "n"]).select("key", F.col("to").alias("n")), "cuts-reached")
        if more.isEmpty():
            break
        reached = reached.union(more)
        further = jumps.select("key", F.col("n").alias("to"), F.col("to").alias("beyond"))
        old, jumps = jumps, written(jumps.join(further, ["key", "to"]).select("key", "n", F.col("beyond").alias("to")), "cuts-jumps")
        discard(old)
    discard(more, jumps)
    marked = placed.join(reached.withColumn("first", F.lit(1)), ["key", "n"], "left")
    out = scan(marked, "key", F.col("seq"), ROWS, ["seq"], batch=Running("sum", F.coalesce("first", F.lit(0))))
    return out.select("row.*", (F.col("batch") - 1).alias(output))


def batches(df: DataFrame, keys: list[str], order: list[str], size: str, output: str = "batch", most_items: int = LIMITS.batch_items, most_bytes: int = LIMITS.navigation_bytes) -> DataFrame:
    """Number greedy batches: a new one at ``most_items``, or when the sizes' sum would pass
    ``most_bytes``. Items too large by themselves must have been taken out before."""
    return cuts(df, keys, order, output, most_items, most_bytes, F.col("sum") - F.col("size"), F.col("sum"), F.col(size))


def groups(df: DataFrame, keys: list[str], order: list[str], start: str, end: str, output: str = "group", most_units: int = LIMITS.group_units, most_bytes: int = LIMITS.group_bytes) -> DataFrame:
    """Number groups of units: a new one at ``most_units``, or when the text from the group's first
    start to this unit's end is longer than ``most_bytes``; gaps count, a lone unit may exceed."""
    return cuts(df, keys, order, output, most_units, most_bytes, F.col(f"row.{start}"), F.col(f"row.{end}"), F.lit(0))
