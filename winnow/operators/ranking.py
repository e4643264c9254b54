"""Scores: combining, thresholds, best of a group, rankings, and joins with answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.limits import LIMITS


def combine(relevance: Column, scope: Column, reference: Column | None = None) -> Column:
    """As high as both relevance and scope, or as the reference alone."""
    both = F.least(relevance, scope)
    return F.greatest(both, reference) if reference is not None else F.greatest(both, F.lit(0.0))


def above(df: DataFrame, score: str, threshold: float = LIMITS.threshold) -> DataFrame:
    return df.where(F.col(score) > threshold)


def best(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(score).alias(score))


def latest(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value of the last pass for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def rank_files(df: DataFrame, score: str = "score") -> DataFrame:
    return df.orderBy(F.col(score).desc(), "path")


def top_files(df: DataFrame, k: int = LIMITS.default_results, score: str = "score") -> DataFrame:
    if not 1 <= k <= LIMITS.most_results:
        raise ValueError(f"limit must be 1 to {LIMITS.most_results}")
    return rank_files(df, score).limit(k)


def ranked_ranges(df: DataFrame, k: int | None = None, key: str = "path") -> DataFrame:
    """Each key's ranges by relevance, start and end; ``rank`` from 1, at most k."""
    order = Window.partitionBy(key).orderBy(F.col("relevance").desc(), "start_line", "end_line")
    out = df.withColumn("rank", F.row_number().over(order).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def zip_answers(items: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Items and scores of the same call by position."""
    return items.join(scores, [key, "ord"])


def answer_problems(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """key, valid: each question answered exactly once, by nothing else, with a probability."""
    counted = answered.groupBy(key, "question").agg(F.count(F.lit(1)).alias("times"), F.min("probability").alias("low"), F.max("probability").alias("high"))
    both = asked.select(key, "question", F.lit(True).alias("was_asked")).join(counted, [key, "question"], "full")
    good = F.col("was_asked") & (F.col("times") == 1) & (F.col("low") >= 0) & (F.col("high") <= 1)
    return both.groupBy(key).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("good")).select(key, (F.col("good") == 1).alias("valid"))


def with_selections(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files with their ranges as one ordered array; files without any keep an empty one."""
    entry = F.struct((-F.col("relevance")).alias("order"), "start_line", "end_line", "relevance")
    own = ranges.groupBy("path").agg(F.array_sort(F.collect_list(entry)).alias("ranges"))
    kind = "array<struct<order:double,start_line:bigint,end_line:bigint,relevance:double>>"
    return files.join(own, "path", "left").withColumn("ranges", F.coalesce("ranges", F.array().cast(kind)))
