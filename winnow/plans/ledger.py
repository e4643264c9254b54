"""A ledger of requests by their content: what has been answered is committed, and not asked again.

A task that asks a model and is lost asks all its requests anew, and each is billed. So requests are asked
slice by slice, and a slice's answers are appended to a table before the next slice begins: an append is
committed whole or not at all. What a run finds in the table it does not ask; a lost task or a run that died
repeats one slice at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.sources.store import discard, written

KEPT = "request string, key string, p double, failure string, attempts long, input_tokens long, output_tokens long, model string"


def request_id() -> Column:
    """The SHA-256 of all that a request says; requests that say the same are one."""
    return F.sha2(F.to_json(F.struct("state", "keys", "questions")), 256)


def answered(requests: DataFrame, ask: Callable[[DataFrame], DataFrame], at: str, most: int = LIMITS.concurrent) -> DataFrame:
    """batch, and the columns of ``ask``'s answers, for each key of each request (batch, state, keys, questions).

    ``at`` names the ledger; it may be shared by any number of searches one after another. ``most`` requests
    or so make a slice. A request whose answers failed, any of them, is asked again by the next run, not by
    this one; an answer stands before a failure.
    """
    spark = requests.sparkSession
    # the table is there from the first run on
    spark.createDataFrame([], KEPT).write.mode("append").parquet(at)
    asked = written(requests.select("batch", "state", "keys", "questions", request_id().alias("request")), "ledger-asked")
    kept = spark.read.schema(KEPT).parquet(at)
    done = kept.groupBy("request", "key").agg(F.min(F.col("failure").isNotNull()).alias("failed")).groupBy("request").agg(F.max("failed").alias("failed")).where("NOT failed")
    once = asked.groupBy("request").agg(*[F.min_by(c, "batch").alias(c) for c in ("state", "keys", "questions")], F.min("batch").alias("batch"))
    left = written(once.join(done, "request", "left_anti"), "ledger-left")
    slices = -(-left.count() // most)
    for i in range(slices):
        own = left.where(F.pmod(F.xxhash64("request"), F.lit(slices)) == i)
        answers = ask(own.select("batch", "state", "keys", "questions")).join(own.select("batch", "request"), "batch")
        answers.select(*[c.split()[0] for c in KEPT.split(", ")]).write.mode("append").parquet(at)
    discard(left)
    kept = spark.read.schema(KEPT).parquet(at)
    told = F.struct("p", "failure", "attempts", "input_tokens", "output_tokens", "model")
    best = kept.join(asked.select("request").distinct(), "request", "left_semi").groupBy("request", "key").agg(F.min_by(told, F.col("failure").isNotNull()).alias("told"))
    return asked.select("batch", "request").join(best, "request").select("batch", "key", "told.*")
