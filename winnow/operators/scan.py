"""Running sums, maxima and next places along the rows of a key, in two levels.

A window over a key puts all its rows into one task, and one long text may be one key. Here a key's rows
are divided into stretches of their place: each stretch is scanned by itself, the stretches' totals
are scanned in a second, small pass (a row a stretch), and what lies before a stretch is carried in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.sources.store import written


@dataclass(frozen=True)
class Running:
    """``kind``: "sum" or "max" of ``value`` over the rows so far, with or without the own one; or "next", the
    least ``value`` after the own row where values rise with the rows. A sum over no rows is 0, others null."""

    kind: str
    value: Column
    own: bool = True


def scan(rows: DataFrame, key: str, place: Column, width: int, order: list, **wanted: Running) -> DataFrame:
    """``rows`` with a column for each of ``wanted``.

    ``order`` sorts a key's rows; ``place`` never falls along it, and rows of one ``width`` of it are scanned
    together. A null key is a key.
    """
    rows = rows.withColumn("_stretch", F.floor(place / width))
    here = Window.partitionBy(key, "_stretch").orderBy(*order)
    first, before = Window.unboundedPreceding, {True: here.rowsBetween(Window.unboundedPreceding, 0), False: here.rowsBetween(Window.unboundedPreceding, -1)}
    local, totals, carried = {}, [], []
    along = Window.partitionBy(key).orderBy("_stretch")
    for name, r in wanted.items():
        if r.kind == "next":
            local[name] = F.lead(r.value).over(here)
            totals.append(F.min(r.value).alias(name))
            carried.append(F.lead(name).over(along).alias(name))
        else:
            total = {"sum": F.sum, "max": F.max}[r.kind]
            local[name] = total(r.value).over(before[r.own])
            totals.append(total(r.value).alias(name))
            carried.append(total(name).over(along.rowsBetween(first, -1)).alias(name))
    sums = rows.groupBy(key, "_stretch").agg(*totals)
    carried = sums.select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), *[c.alias(f"_{n}") for n, c in zip(wanted, carried, strict=True)])
    # most keys have one stretch, into which nothing is carried
    carried = carried.where(" OR ".join(f"_{n} IS NOT NULL" for n in wanted))
    out = rows.withColumns(local).join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")), "left")
    both = {
        "sum": lambda n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)),
        "max": lambda n: F.greatest(n, f"_{n}"),
        "next": lambda n: F.coalesce(n, f"_{n}"),
    }
    kept = [c for c in rows.columns if c != "_stretch" and c not in wanted]
    return out.select(*kept, *[both[r.kind](n).alias(n) for n, r in wanted.items()])


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` written in the order of the given columns, with a rising number ``seq``.

    The order is by ranges, so a key with most of the rows is spread over many tasks.
    """
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "numbered")
