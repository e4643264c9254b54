"""Exploring a tree by scores: only directories that score above the threshold are opened."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.sources.store import written


def levels(entries: DataFrame, judged: DataFrame, threshold: float = LIMITS.threshold) -> DataFrame:
    """round, path of all entries kept, level by level from the root.

    Top directories are opened unjudged. Below them an entry is kept if its score (judged: path, p)
    is above the threshold, and kept directories are opened in the next round. Each directory is
    opened once: it has one parent. A round's result is a written table, so plans stay short.
    """
    open_dirs = entries.where("parent = '' AND path <> ''").select(F.lit(1).cast("long").alias("round"), "path", "kind")
    kept = front = written(open_dirs, "levels")
    good = judged.where(F.col("p") > threshold).select("path")
    for n in itertools.count(2):
        opened = front.where("kind = 'directory'").select(F.col("path").alias("parent"))
        below = entries.join(opened, "parent", "left_semi").join(good, "path", "left_semi")
        front = written(below.select(F.lit(n).cast("long").alias("round"), "path", "kind"), "levels")
        if front.isEmpty():
            break
        kept = kept.unionByName(front)
    return kept
