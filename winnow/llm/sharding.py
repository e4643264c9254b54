"""Sharding by rendezvous hashing of stable keys over weighted shards, in DataFrame operations only.

Every (key, shard) pair has a hash u in (0, 1); a key goes to the shard with the least
-ln(u) / weight. A shard's chance is its weight over all weights, and adding a shard moves only the
keys that the new one wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import durable

#: Hexadecimal digits of the MD5 of key and text checksum that name a range of a shard's numbering: 4096 ranges.
RANGE_DIGITS = 3


def pair_hash(key: Column, shard: int) -> Column:
    """The first 52 bits of MD5("key:shard") as a double in (0, 1)."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) that wins ``key``; ties go to the lower shard."""
    races = [F.struct((-F.log(pair_hash(key, s)) / float(w)).alias("cost"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (F.least(*races) if len(races) > 1 else races[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """Assign every document to a shard and number it there.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (gapless from
    0 within the shard), grown_shard (where the weights ``grown`` would put it; null if not given).

    Null text counts as empty. Null ids share one key and so one shard; rows with equal ids share
    a shard. Slots are counted in ranges of a hash of key and text, so no task holds a whole shard,
    nor all rows of one key, but for rows equal in key and text. Ties within a range go by id, then
    by the text's checksum and size. Of long texts only sizes and checksums are moved. An empty
    table gives an empty result. Other columns are ignored.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    base = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), rendezvous(key, weights).cast("int").alias("shard"), (rendezvous(key, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"), F.substring(F.md5(F.concat(key, F.lit(":"), F.crc32(raw).cast("string")).cast("binary")), 1, RANGE_DIGITS).alias("range"))
    base = durable(base, "sharding", few_files=True)
    counts = base.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    numbered = base.withColumn("at", F.row_number().over(within) - 1)
    slot = (F.col("start") + F.col("at")).cast("long")
    return numbered.join(starts, ["shard", "range"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")
