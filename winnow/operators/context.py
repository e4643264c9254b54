"""The source that goes along with a group of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.limits import LIMITS, Limits


def group_context(lines: DataFrame, groups: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """For each group (doc_id, block_start, block_end) the byte spans of its context.

    A small file is sent whole (opening_end is its size); of others the opening lines, and the lines
    around the group.
    """
    near, opening = limits.context_lines, limits.opening_lines
    files = lines.groupBy("doc_id").agg(F.max("line_no").alias("last"), F.max("byte_end").alias("size"), F.max(F.when(F.col("line_no") <= opening, F.col("byte_end"))).alias("opening"))
    spans = groups.join(files, "doc_id").withColumn("a", F.greatest(F.col("block_start") - near, F.lit(1).cast("long"))).withColumn("z", F.least(F.col("block_end") + near, F.col("last")))
    starts = lines.select("doc_id", F.col("line_no").alias("a"), F.col("byte_start").alias("near_start"))
    ends = lines.select("doc_id", F.col("line_no").alias("z"), F.col("byte_end").alias("near_end"))
    whole = F.col("size") <= limits.whole_file_bytes
    out = spans.join(starts, ["doc_id", "a"]).join(ends, ["doc_id", "z"])
    return out.select("doc_id", "block_start", F.when(whole, "whole").otherwise("around").alias("kind"), F.when(whole, F.col("size")).otherwise(F.col("opening")).alias("opening_end"), F.when(whole, F.lit(0).cast("long")).otherwise(F.col("near_start")).alias("near_start"), F.when(whole, F.lit(0).cast("long")).otherwise(F.col("near_end")).alias("near_end"))
