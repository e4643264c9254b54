"""Counts, issues, usage, calls and captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.limits import LIMITS, Limits


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))


def first_issue(issues: DataFrame, order: list[str]) -> DataFrame:
    """The first issue of each search; arrival order is not fixed, so it is by ``order``."""
    first = F.min_by(F.struct("kind", "code"), F.struct(*order))
    return issues.groupBy("search").agg(first.alias("first")).select("search", "first.kind", "first.code")


def status(issues: Column, cancelled: Column) -> Column:
    return F.when(cancelled > 0, "interrupted").when(issues > 0, "incomplete").otherwise("complete")


def usage(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.count(F.lit(1)).alias("requests"))


def last_reported(attempts: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value that is not null."""
    return attempts.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def keep_first(rows: DataFrame, identity: list[str], order: str) -> DataFrame:
    """One row of each identity, the first."""
    w = Window.partitionBy(*identity).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def budgeted_read(files: DataFrame, key: str = "call", most: int = LIMITS.ask_bytes) -> DataFrame:
    """Files of a call in order as long as their bytes together stay within ``most``."""
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("total", F.sum("bytes").over(order)).where(F.col("total") <= most)


def question_error(question: Column, limits: Limits = LIMITS) -> Column:
    """Why a question is refused; null if it is not."""
    return F.when(F.trim(question) == "", "blank").when(F.octet_length(question) > limits.question_bytes, "too_long")


def finished(started: DataFrame, ends: DataFrame) -> DataFrame:
    """Captures with what is known of their ends; running ones keep nulls."""
    return started.join(ends, "id", "left").withColumn("duration_seconds", F.round((F.col("ended_at_unix") - F.col("started_at_unix")) * 10) / 10)


def summary(out: Column, err: Column, code: Column, folder: Column, limits: Limits = LIMITS) -> Column:
    """What is shown of a finished command: its output if it is short, then facts about it."""
    n, m = F.octet_length(out), F.octet_length(err)
    nl = F.lit("\n")
    closed = lambda s: F.when((s == "") | s.endswith("\n"), s).otherwise(F.concat(s, nl))
    shown = F.concat(F.when(m > 0, F.concat(closed(out), F.lit("--- stderr\n"), err)).otherwise(out))
    text = lambda x: x.cast("string")
    facts = F.concat(F.lit("exit_code: "), text(code), F.lit("\nstdout: "), text(n), F.lit(" bytes "), folder, F.lit("/stdout.log\nstderr: "), text(m), F.lit(" bytes "), folder, F.lit("/stderr.log\n"))
    return F.when(n + m <= limits.shown_bytes, F.concat(closed(shown), facts)).otherwise(F.concat(facts, F.lit("output not shown\n")))


def parsed_answers(replies: DataFrame, body: str = "body", asked: str = "asked") -> DataFrame:
    """``replies`` with ``answers``, a map from each asked key to its probability, or null.

    The body is JSON text, an object with the object ``answers``. A body that is no JSON, that has a key
    twice, lacks a key that was asked or has another one, or a value that is no number from 0 to 1, has no
    answers at all.
    """
    # a key that stands twice is no JSON here: the session's spark.sql.variant.allowDuplicateKeys is false by default
    answers = F.try_variant_get(F.try_parse_json(body), "$.answers", "map<string,double>")
    kinds = F.try_variant_get(F.try_parse_json(body), "$.answers", "map<string,variant>")
    numbers = F.forall(F.map_values(kinds), lambda v: ~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID"))
    whole = (F.size(F.array_except(F.map_keys(answers), asked)) == 0) & (F.size(F.array_except(asked, F.map_keys(answers))) == 0)
    within = F.forall(F.map_values(answers), lambda p: p.isNotNull() & (p >= 0) & (p <= 1))
    return replies.withColumn("answers", F.when(whole & within & numbers, answers))
