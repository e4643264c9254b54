"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule w(t), linear between equally spaced knots over the run,
t in [0, 1]. Its integral W(t) says how much of the source's words the run has asked for by t.
A source's documents stand in a fixed order (by the MD5 of id and text) and are read in epochs; a
reading whose middle lies at the fraction u of the source's target belongs at W^-1(u W(1)). The
mix is range-sorted by that position.

Nothing but ids and sizes is shuffled. A source's running sum is built from sums over ranges of
the MD5, so that a source with a third of all rows spreads over thousands of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, durable

#: Weights dealt in turn to the sources in code-point order.
CYCLE = (3, 1, 2)
#: How each weight moves over the run, as factors at equally spaced knots, dealt in turn too.
#: Their trapezoid mean is 1, so a schedule changes when a source is read and not how much.
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Hexadecimal digits of the MD5 that name a range: 16**3 = 4096 ranges for each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """One row per source: its rank, weight, size and target words.

    The targets share ``share`` times all words by weight. A source's target stops at ``cap``
    times its size, and the excess goes to the others by weight until none is above. Sources are
    filled in order of size over weight; once one is below its cap, all later ones are.
    """
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle)) + 1).cast("long"))
    per = per.withColumns({
        "total": F.sum("source_size").over(every),
        "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "used": cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
    })
    fair = F.col("weight") * (share * F.col("total") - F.col("used")) / F.col("left_weight")
    full = F.col("source_size") * F.lit(cap)
    # Once a source is not cut, the level stays: later sources get the level found there.
    per = per.withColumn("level", F.when(full > fair, fair / F.col("weight")))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("level") * F.col("weight"), full).cast("double")
    return per.select("source", "rank", "weight", "source_size", target.alias("target"))


def schedule_time(u: Column, shape: Column, knots: int) -> Column:
    """t where the integral of the schedule reaches the fraction u of its whole.

    ``shape``: the schedule's values at ``knots`` equally spaced times. Within a segment from a to
    b the integral is quadratic, and its inverse is written in the form that is stable for a = b.
    """
    h = 1.0 / (knots - 1)
    at = [F.element_at(shape, i + 1) for i in range(knots)]
    areas = [(at[i] + at[i + 1]) * (h / 2) for i in range(knots - 1)]
    starts = [F.lit(0.0)]
    for a in areas:
        starts.append(starts[-1] + a)
    goal = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * starts[-1]
    out = F.lit(1.0)
    for i in reversed(range(knots - 1)):
        rest, slope = goal - starts[i], (at[i + 1] - at[i]) / h
        root = F.sqrt(F.greatest(at[i] * at[i] + 2.0 * slope * rest, F.lit(0.0)))
        t = i * h + F.coalesce(F.try_divide(2.0 * rest, at[i] + root), F.lit(0.0))
        out = F.when(goal <= starts[i + 1], F.least(t, F.lit((i + 1) * h))).otherwise(out)
    return out


def row_key(docs: DataFrame) -> Column:
    """What a source's documents are ordered by: the MD5 of id and text. Rows of one id, null ids among
    them, are told apart by their texts, so that they spread over the ranges too."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(text("doc_id"), F.lit(":"), text("text")).cast("binary"))


def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, cycle: tuple[int, ...] = CYCLE, shapes=SHAPES) -> DataFrame:
    """Decide for every document how often the mix reads it, and when.

    Columns: doc_id, source, size, source_size, target, taken (words read, repeats counted),
    readings (how often), positions (of each reading in the run, in [0, 1]; empty if never read).

    ``cap`` is a whole number: sources stop at that many times their size, documents at that many
    readings. Documents are read whole: one is read in an epoch if its middle word lies before the
    target, so a source's sum misses its target by at most half a document, however long the
    longest text is. Null text has size 0; a document of size 0 is read once where its place lies
    before the target, with taken 0. Null sources form one source. Rows with equal or null ids keep
    their own rows; rows equal in id and text are alike, share a range of the order, and get
    neighbouring places. An empty table gives an empty result. Columns beyond doc_id, text and
    source are ignored.
    """
    if cap != int(cap) or cap < 1:
        raise ValueError("documents are read whole, so the cap is a whole number")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(docs).alias("key"))
    keyed = durable(sizes, "mixing-sizes", few_files=True).withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    targets = source_targets(keyed, share, float(cap), cycle)
    sums = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_start"))
    # One row per source and range; the sources' own columns ride along to the documents.
    sums = sums.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).select("s.*", "rank", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # Joined on null-safe equal keys: a null source is a source like any other.
    rows = placed.alias("p").join(sums.alias("s"), F.expr("p.source <=> s.source AND p.part = s.part"), "left").select("p.doc_id", "p.source", "p.size", "p.start", "s.part_start", "s.rank", "s.source_size", "s.target")
    middle = F.col("start") + F.col("part_start") + F.col("size") / 2.0
    shape = F.element_at(F.array(*(F.array(*map(F.lit, s)) for s in shapes)), (F.col("rank") % len(shapes)) + 1)
    rows = rows.select("doc_id", "source", "size", "source_size", "target", middle.alias("middle"), shape.alias("shape"))
    at = [F.col("middle") + F.lit(e) * F.col("source_size") for e in range(int(cap))]
    when = lambda x: schedule_time(F.try_divide(x, F.col("target")), F.col("shape"), len(shapes[0]))
    positions = F.filter(F.array(*(F.when(x < F.col("target"), when(x)) for x in at)), lambda x: x.isNotNull())
    rows = rows.withColumn("positions", positions).withColumn("readings", F.size("positions").cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("readings")).alias("taken"), "readings", "positions")


def mix_order(mixed: DataFrame) -> DataFrame:
    """Range-sort the mix's documents by their first training position; unread documents come last."""
    return mixed.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")


def schedule(mixed: DataFrame) -> DataFrame:
    """doc_id, reading (from 1) and position: a row for each reading, range-sorted by position."""
    each = mixed.select("doc_id", F.posexplode("positions").alias("at", "position"))
    return each.select("doc_id", (F.col("at") + 1).cast("int").alias("reading"), "position").orderBy("position", "doc_id", "reading")
