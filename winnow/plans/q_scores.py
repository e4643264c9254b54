"""Queries over scores, joins and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.operators import ranking as R
from winnow.plans import inputs as I
from winnow.plans.catalog import query
from winnow.plans.q_basic import literals

# Ranges of a document: its blocks of 16 lines with a score from block and id
RANGES = I.sql("vlines", "vscore") + ", last AS (SELECT doc_id, max(line_no) AS n FROM vlines GROUP BY doc_id), ranges AS (SELECT v.path, s AS start_line, least(s + 3, n) AS end_line, ((v.doc_id * 31 + s * 17) % 100) / CAST(100 AS DOUBLE) AS relevance FROM last JOIN vscore v USING (doc_id), LATERAL (SELECT unnest(range(1, n + 1, 4)) AS s))"


def range_rows(spark, sf):
    last = I.vlines(spark, sf).groupBy("doc_id").agg(F.max("line_no").alias("n"))
    rows = last.join(I.vscore(spark, sf).select("doc_id", "path"), "doc_id").withColumn("start_line", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(4).cast("long"))))
    score = ((F.col("doc_id") * 31 + F.col("start_line") * 17) % 100) / F.lit(100).cast("double")
    return rows.select("path", "start_line", F.least(F.col("start_line") + 3, F.col("n")).alias("end_line"), score.alias("relevance"))


def scores(spark, sf):
    return I.vscore(spark, sf)


@query(I.sql("vscore") + "SELECT path, p1 FROM vscore WHERE p1 > 0.5")
def threshold(spark, sf):
    return R.above(scores(spark, sf), "p1").select("path", "p1")


@query(I.sql("vscore") + "SELECT path, greatest(least(p1, p2), p3) AS score FROM vscore")
def combine_score(spark, sf):
    return scores(spark, sf).select("path", R.combine(F.col("p1"), F.col("p2"), F.col("p3")).alias("score"))


@query("SELECT conv_id AS call, turn AS ord, role AS question, ((conv_id * 13 + turn * 7) % 10) / CAST(10 AS DOUBLE) AS probability FROM conversations")
def zip_answers(spark, sf):
    asks = I.table(spark, sf, "conversations").select(F.col("conv_id").alias("call"), F.col("turn").alias("ord"), F.col("role").alias("question"))
    answers = asks.select("call", "ord", (((F.col("call") * 13 + F.col("ord") * 7) % 10) / F.lit(10).cast("double")).alias("probability"))
    return R.zip_answers(asks, answers, "call")


# Calls divisible by 5 miss an answer, by 7 have one twice, by 11 one out of range, by 13 an unasked one
ANSWERED = "a AS (SELECT conv_id AS call, turn AS question, 0.5::DOUBLE AS probability FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 0) UNION ALL SELECT conv_id, turn, 0.5 FROM conversations WHERE conv_id % 7 = 0 AND turn = 0 UNION ALL SELECT DISTINCT conv_id, -1, 0.5 FROM conversations WHERE conv_id % 13 = 0), q AS (SELECT conv_id AS call, turn AS question FROM conversations), b AS (SELECT call, question, CASE WHEN call % 11 = 0 THEN 1.5 ELSE probability END AS probability FROM a)"


@query(f"WITH {ANSWERED}, c AS (SELECT call, question, count(*) AS n, min(probability) AS lo, max(probability) AS hi FROM b GROUP BY ALL) SELECT coalesce(q.call, c.call) AS call, bool_and(coalesce(q.call IS NOT NULL AND c.n = 1 AND c.lo >= 0 AND c.hi <= 1, false)) AS valid FROM q FULL JOIN c ON q.call = c.call AND q.question = c.question GROUP BY 1")
def answer_set_check(spark, sf):
    asked = I.table(spark, sf, "conversations").select(F.col("conv_id").alias("call"), F.col("turn").alias("question"))
    half = F.lit(0.5)
    plain = asked.where(~((F.col("call") % 5 == 0) & (F.col("question") == 0)))
    twice = asked.where((F.col("call") % 7 == 0) & (F.col("question") == 0))
    extra = asked.where(F.col("call") % 13 == 0).select("call").distinct().select("call", F.lit(-1).cast("long").alias("question"))
    answers = plain.unionByName(twice).unionByName(extra).withColumn("probability", F.when(F.col("call") % 11 == 0, 1.5).otherwise(half))
    return R.answer_problems(asked, answers, "call")


@query(I.sql("vscore") + "SELECT path, kind, kind || doc_id % 3 AS key FROM vscore, (VALUES ('q'), ('scope'), ('ref')) k(kind)")
def unit_questions(spark, sf):
    kinds = F.explode(F.array(F.lit("q"), F.lit("scope"), F.lit("ref")))  # two or three literals to a unit
    return scores(spark, sf).select("path", "doc_id", kinds.alias("kind")).select("path", "kind", F.concat("kind", (F.col("doc_id") % 3).cast("string")).alias("key"))


@query(I.sql("vfiles", "vscore") + "SELECT s.path, sha256(f.text) AS sha256 FROM vscore s JOIN vfiles f USING (path) WHERE s.p1 > 0.5")
def path_hash_lookup(spark, sf):
    snapshots = I.vfiles(spark, sf).select("path", F.sha2("text", 256).alias("sha256"))
    return R.above(scores(spark, sf), "p1").select("path").join(snapshots, "path")


@query(I.sql("vscore") + "SELECT path, p1 AS score, 'item' AS kind FROM vscore UNION ALL SELECT path, p2, 'chunk' FROM vscore")
def scored_union(spark, sf):
    s = scores(spark, sf)
    items = s.select("path", F.col("p1").alias("score"), F.lit("item").alias("kind"))
    return items.unionByName(s.select("path", F.col("p2").alias("score"), F.lit("chunk").alias("kind")))


@query(RANGES + " SELECT path, max(relevance) AS relevance FROM ranges GROUP BY path")
def best_score(spark, sf):
    return R.best(range_rows(spark, sf), ["path"], "relevance")


@query(RANGES + " SELECT path, start_line, CASE WHEN start_line % 8 = 1 THEN 1 - relevance ELSE relevance END AS relevance, CASE WHEN start_line % 8 = 1 THEN 2 ELSE 1 END::INTEGER AS pass FROM ranges")
def latest_decision(spark, sf):
    r = range_rows(spark, sf)
    first = r.withColumn("pass", F.lit(1))
    second = r.where("start_line % 8 = 1").withColumn("relevance", 1 - F.col("relevance")).withColumn("pass", F.lit(2))
    return R.latest(first.unionByName(second), ["path", "start_line"], "pass", "relevance")


@query(RANGES + ", f AS (SELECT path, p1 FROM vscore WHERE p1 > 0.5), r AS (SELECT * FROM ranges WHERE relevance > 0.9) SELECT f.path, f.p1 AS score, count(r.path) AS n_ranges, coalesce(max(r.relevance), -1) AS best FROM f LEFT JOIN r USING (path) GROUP BY ALL")
def files_left_selections(spark, sf):
    files = R.above(scores(spark, sf), "p1").select("path", F.col("p1").alias("score"))
    out = R.with_selections(files, R.above(range_rows(spark, sf), "relevance", 0.9))
    return out.select("path", "score", F.size("ranges").cast("long").alias("n_ranges"), F.coalesce(F.try_element_at("ranges", F.lit(1))["relevance"], F.lit(-1.0)).alias("best"))


@query(I.sql("vscore") + "SELECT path, p1 AS score FROM vscore WHERE p1 > 0.5 ORDER BY score DESC, path")
def rank_files(spark, sf):
    return R.rank_files(R.above(scores(spark, sf), "p1").select("path", F.col("p1").alias("score")))


@query(I.sql("vscore") + "SELECT path, p1 AS score FROM vscore WHERE p1 > 0.5 ORDER BY score DESC, path LIMIT 10")
def topk_files(spark, sf):
    return R.top_files(R.above(scores(spark, sf), "p1").select("path", F.col("p1").alias("score")))


@query(RANGES + " SELECT path, start_line, end_line, relevance, row_number() OVER (PARTITION BY path ORDER BY relevance DESC, start_line, end_line) AS rank FROM ranges")
def rank_ranges(spark, sf):
    return R.ranked_ranges(range_rows(spark, sf))


@query(RANGES + " SELECT * FROM (SELECT path, start_line, end_line, relevance, row_number() OVER (PARTITION BY path ORDER BY relevance DESC, start_line, end_line) AS rank FROM ranges) WHERE rank <= 5")
def topk_ranges(spark, sf):
    return R.ranked_ranges(range_rows(spark, sf), LIMITS.ranges_shown)


@query(RANGES + ", f AS (SELECT path, p1 FROM vscore WHERE p1 > 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY relevance DESC, start_line, end_line) AS rank FROM ranges WHERE relevance > 0.5) SELECT '/base/' || f.path AS path, f.p1 AS score, r.start_line, r.end_line, r.relevance FROM f JOIN r ON r.path = f.path AND r.rank <= 5")
def result_projection(spark, sf):
    files = R.above(scores(spark, sf), "p1").select("path", F.col("p1").alias("score"))
    shown = R.with_selections(files, R.above(range_rows(spark, sf), "relevance")).withColumn("range", F.explode(F.slice("ranges", 1, LIMITS.ranges_shown)))
    return shown.select(F.concat(F.lit("/base/"), "path").alias("path"), "score", "range.start_line", "range.end_line", "range.relevance")


@query(I.sql("vscore") + "SELECT path, p1 FROM vscore WHERE p2 > 0.5 AND p1 > 0.5 ORDER BY p1 DESC, path LIMIT 1")
def anchor_pick(spark, sf):
    usable = scores(spark, sf).where("p2 > 0.5").select("path", "p1")
    return R.top_files(R.above(usable, "p1"), 1, "p1")


@query(RANGES + " SELECT path, start_line, end_line FROM ranges WHERE relevance > 0.5 ORDER BY path, start_line")
def evidence_flatten(spark, sf):
    entry = F.collect_list(F.struct("start_line", "end_line")).alias("excerpts")  # a file's excerpts
    nested = R.above(range_rows(spark, sf), "relevance").groupBy("path").agg(entry)
    return nested.select("path", F.explode("excerpts").alias("e")).select("path", "e.start_line", "e.end_line").orderBy("path", "start_line")


DIRSCORE = ", ds AS (SELECT dir, ((min(doc_id) * 7919) % 1000) / CAST(1000 AS DOUBLE) AS p FROM vscore GROUP BY dir)"


@query(I.sql("vscore") + DIRSCORE + " SELECT 1::BIGINT AS round, split_part(dir, '/', 1) AS path FROM ds GROUP BY ALL UNION ALL SELECT 2, dir FROM ds WHERE p > 0.5 UNION ALL SELECT 3, v.path FROM vscore v JOIN ds USING (dir) WHERE ds.p > 0.5 AND v.p1 > 0.5")
def bfs_levels(spark, sf):
    from winnow.plans import navigate

    s = scores(spark, sf)
    judged = s.groupBy("dir").agg(F.min("doc_id").alias("doc_id")).select(F.col("dir").alias("path"), I.score(I.PRIMES[0]).alias("p"))
    judged = judged.unionByName(s.select("path", F.col("p1").alias("p")))
    return navigate.levels(I.ventries(spark, sf), judged).select("round", "path")
