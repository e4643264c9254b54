"""Queries over issues, usage, calls, captures and budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from winnow.limits import LIMITS
from winnow.operators import bookkeeping as K
from winnow.operators import budget as B
from winnow.plans import inputs as I
from winnow.plans.catalog import query

# A request asks about up to 64 turns. By its number, replies are right, have a key twice, lack the last, have one more, a value
# above 1, or a text for a number.
FAULTS = 6
REPLIES = ", t AS (SELECT call, ord // 64 AS part, ord, 'q' || ord AS k, (bytes % 1000) / 1000.0::DOUBLE AS p, max(ord) OVER (PARTITION BY call, ord // 64) AS final, (call + ord // 64) % 6 AS fault FROM (SELECT DISTINCT call, ord, max(bytes) OVER (PARTITION BY call, ord) AS bytes FROM vask))"


@query(I.sql("vask") + REPLIES + " SELECT call, part::BIGINT AS part, ord::BIGINT AS ord, CASE WHEN fault = 0 THEN p END AS p FROM t")
def answer_parse(spark, sf):
    """The answers to questions about each turn, read from replies in JSON, faulty ones among them."""
    t = I.vask(spark, sf).groupBy("call", "ord").agg(F.max("bytes").alias("bytes"))
    t = t.select("call", F.expr("ord div 64").cast("long").alias("part"), F.col("ord").cast("long").alias("ord"), F.concat(F.lit("q"), F.col("ord").cast("string")).alias("k"), ((F.col("bytes") % 1000) / 1000.0).alias("p"))
    pair = F.concat(F.lit('"'), F.col("k"), F.lit('":'), F.col("p").cast("string"))
    # at most 64 turns to a request
    per = t.groupBy("call", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "k", pair.alias("pair")))).alias("a"))
    fault = (F.col("call") + F.col("part")) % FAULTS
    pairs, first = F.col("a.pair"), F.col("a.k")[0]
    said = F.when(fault == 1, F.concat(pairs, F.slice(pairs, 1, 1))).when(fault == 2, F.slice(pairs, 1, F.size(pairs) - 1)).when(fault == 3, F.concat(pairs, F.array(F.lit('"other":0.5'))))
    replaced = lambda v: F.concat(F.array(F.concat(F.lit('"'), first, F.lit(f'":{v}'))), F.slice(pairs, 2, F.size(pairs)))
    said = said.when(fault == 4, replaced("1.5")).when(fault == 5, replaced('"0.5"')).otherwise(pairs)
    body = F.concat(F.lit('{"model":"m","answers":{'), F.array_join(said, ","), F.lit("}}"))
    got = K.parsed_answers(per.select("call", "part", F.col("a.k").alias("asked"), F.col("a.ord").alias("ord"), body.alias("body")))
    each = got.select("call", "part", "answers", F.explode("ord").alias("ord"))
    return each.select("call", "part", "ord", F.try_element_at("answers", F.concat(F.lit("q"), F.col("ord").cast("string"))).alias("p"))


ISSUES = "issues AS (SELECT event_id, search, CASE status WHEN 529 THEN 'provider' WHEN 429 THEN 'budget' ELSE 'unreadable' END AS kind, CASE status WHEN 529 THEN 'provider_unavailable' WHEN 429 THEN 'budget_exhausted' ELSE 'source_unreadable' END AS code, ts FROM vattempts WHERE status <> 200)"
WITH_ISSUES = I.sql("vattempts") + ", " + ISSUES + " "


def issues_of(spark, sf):
    s = F.col("status")
    return I.vattempts(spark, sf).where(s != 200).select("event_id", "search", F.when(s == 529, "provider").when(s == 429, "budget").otherwise("unreadable").alias("kind"), F.when(s == 529, "provider_unavailable").when(s == 429, "budget_exhausted").otherwise("source_unreadable").alias("code"), "ts")


@query(WITH_ISSUES + "SELECT kind, code, count(*) AS n FROM issues GROUP BY ALL")
def issue_counts(spark, sf):
    return K.issue_counts(issues_of(spark, sf))


@query(WITH_ISSUES + "SELECT search, kind, code FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY ts, event_id) AS n FROM issues) WHERE n = 1")
def first_error(spark, sf):
    return K.first_issue(issues_of(spark, sf), ["ts", "event_id"])


@query(I.sql("vscore") + ", ds AS (SELECT dir, ((min(doc_id) * 7919) % 1000) / CAST(1000 AS DOUBLE) AS p FROM vscore GROUP BY dir) SELECT (SELECT count(DISTINCT path) FROM vscore JOIN ds USING (dir) WHERE p > 0.5) AS files_considered, (SELECT count(*) FROM ds WHERE p <= 0.5) AS directories_pruned, (SELECT count(*) FROM vscore JOIN ds USING (dir) WHERE p > 0.5 AND p1 > 0.5) AS matches_found, (SELECT count(*) FROM vscore JOIN ds USING (dir) WHERE p > 0.5 AND p1 > 0.5) > 10 AS results_limited")
def coverage(spark, sf):
    s = I.vscore(spark, sf)
    dirs = s.groupBy("dir").agg(F.min("doc_id").alias("doc_id")).select("dir", I.score(I.PRIMES[0]).alias("p"))
    seen = s.join(dirs, "dir")
    good = F.col("p") > LIMITS.threshold
    counts = seen.agg(F.countDistinct(F.when(good, F.col("path"))).alias("files_considered"), F.countDistinct(F.when(~good, F.col("dir"))).alias("directories_pruned"), F.count_if(good & (F.col("p1") > LIMITS.threshold)).alias("matches_found"))
    return counts.withColumn("results_limited", F.col("matches_found") > LIMITS.default_results)


@query(WITH_ISSUES + "SELECT a.search, CASE WHEN a.search % 10 = 0 THEN 'interrupted' WHEN count(i.event_id) > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM (SELECT DISTINCT search FROM vattempts) a LEFT JOIN issues i ON i.search = a.search GROUP BY a.search")
def search_status(spark, sf):
    n = issues_of(spark, sf).groupBy("search").agg(F.count(F.lit(1)).alias("n"))
    every = I.vattempts(spark, sf).select("search").distinct().join(n, "search", "left")
    return every.select("search", K.status(F.coalesce("n", F.lit(0)), (F.col("search") % 10 == 0).cast("int")).alias("status"))


@query(I.sql("vattempts") + "SELECT coalesce(sum(CASE WHEN status = 200 THEN tokens END), 0)::BIGINT AS input_tokens, count(*) AS requests FROM vattempts")
def usage_totals(spark, sf):
    return K.usage(I.vattempts(spark, sf).withColumn("input_tokens", F.when(F.col("status") == 200, F.col("tokens"))))


@query(I.sql("vattempts") + "SELECT search, arg_max('m' || tokens % 3, event_id) AS model FROM vattempts WHERE status = 200 GROUP BY search")
def last_model(spark, sf):
    model = F.when(F.col("status") == 200, F.concat(F.lit("m"), (F.col("tokens") % 3).cast("string")))
    return K.last_reported(I.vattempts(spark, sf).withColumn("model", model), "search", "model", "event_id")


@query("WITH q AS (SELECT item_id, CASE WHEN item_id % 10 = 0 THEN '  ' WHEN item_id % 10 = 1 THEN repeat(text, 40) ELSE text END AS question FROM benchmark) SELECT item_id, coalesce(CASE WHEN trim(question) = '' THEN 'blank' WHEN strlen(question) > 2048 THEN 'too_long' END, 'ok') AS error FROM q")
def validate_questions(spark, sf):
    q = F.when(F.col("item_id") % 10 == 0, F.lit("  ")).when(F.col("item_id") % 10 == 1, F.repeat("text", F.lit(40))).otherwise(F.col("text"))
    return I.table(spark, sf, "benchmark").select("item_id", F.coalesce(K.question_error(q), F.lit("ok")).alias("error"))


@query("SELECT doc_id, sha256 FROM (SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first(spark, sf):
    rows = I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return K.keep_first(rows, ["sha256"], "doc_id")


@query(I.sql("vask") + "SELECT call, ord, bytes, total::BIGINT AS total FROM (SELECT *, sum(bytes) OVER (PARTITION BY call ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total FROM vask) WHERE total <= 262144")
def ask_budgeted_read(spark, sf):
    return K.budgeted_read(I.vask(spark, sf)).select("call", "ord", "bytes", "total")


@query("SELECT event_id, 'run ' || event_type AS command, '/home/' || user_id AS cwd, 'tool-' || event_id AS tool_use_id, TRY_CAST(props->>'$.k' AS BIGINT) AS timeout FROM events")
def capture_parse(spark, sf):
    raw = F.to_json(F.struct(F.lit("Bash").alias("tool_name"), F.concat(F.lit("tool-"), F.col("event_id").cast("string")).alias("tool_use_id"), F.concat(F.lit("/home/"), F.col("user_id").cast("string")).alias("cwd"), F.struct(F.concat(F.lit("run "), "event_type").alias("command"), F.get_json_object("props", "$.k").cast("long").alias("timeout")).alias("tool_input")))
    schema = "tool_name string, tool_use_id string, cwd string, tool_input struct<command:string,description:string,timeout:bigint,run_in_background:boolean>"
    x = F.from_json("raw", schema)
    return I.table(spark, sf, "events").select("event_id", raw.alias("raw")).select("event_id", x.alias("x")).select("event_id", F.col("x.tool_input.command").alias("command"), "x.cwd", "x.tool_use_id", F.col("x.tool_input.timeout").alias("timeout"))


@query("SELECT event_id AS id, event_type AS command, CASE WHEN event_id % 3 = 0 THEN (user_id % 3)::INTEGER ELSE -1 END AS exit_code, CASE WHEN event_id % 3 = 0 THEN round(value * 10) / 10 ELSE -1 END AS duration_seconds FROM events")
def capture_finish(spark, sf):
    e = I.table(spark, sf, "events")
    started = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("command"), F.lit(0.0).alias("started_at_unix"))
    ends = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).cast("int").alias("exit_code"), F.col("value").alias("ended_at_unix"))
    out = K.finished(started, ends)
    return out.select("id", "command", F.coalesce("exit_code", F.lit(-1)).alias("exit_code"), F.coalesce("duration_seconds", F.lit(-1.0)).alias("duration_seconds"))


SHOWN = "CASE WHEN err <> '' THEN CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END || '--- stderr' || chr(10) || err ELSE text END"
FACTS = "'exit_code: 0' || chr(10) || 'stdout: ' || strlen(text) || ' bytes /r/' || doc_id || '/stdout.log' || chr(10) || 'stderr: ' || strlen(err) || ' bytes /r/' || doc_id || '/stderr.log' || chr(10)"


@query(f"WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'warning' || chr(10) ELSE '' END AS err FROM documents), s AS (SELECT *, {SHOWN} AS shown, {FACTS} AS facts FROM d) SELECT doc_id, CASE WHEN strlen(text) + strlen(err) <= 2048 THEN CASE WHEN shown = '' OR shown LIKE '%' || chr(10) THEN shown ELSE shown || chr(10) END || facts ELSE facts || 'output not shown' || chr(10) END AS value FROM s")
def capture_summary(spark, sf):
    err = F.when(F.col("doc_id") % 2 == 0, "warning\n").otherwise("")
    return I.table(spark, sf, "documents").select("doc_id", K.summary(F.col("text"), err, F.lit(0), F.concat(F.lit("/r/"), F.col("doc_id").cast("string"))).alias("value"))


@query(I.sql("vattempts") + "SELECT event_id, count(*) OVER (PARTITION BY search ORDER BY ts RANGE BETWEEN INTERVAL 59.999999 SECONDS PRECEDING AND CURRENT ROW) AS requests, (sum(tokens) OVER (PARTITION BY search ORDER BY ts RANGE BETWEEN INTERVAL 0.999999 SECONDS PRECEDING AND CURRENT ROW))::BIGINT AS window_tokens FROM vattempts")
def rate_windows(spark, sf):
    return B.rate_windows(I.vattempts(spark, sf)).select("event_id", "requests", "window_tokens")


@query(I.sql("vattempts") + "SELECT a.event_id, count(*) AS requests, (sum(b.tokens) FILTER (b.ts > a.ts - INTERVAL 1 SECOND))::BIGINT AS window_tokens FROM vattempts a JOIN vattempts b ON a.search = b.search AND b.ts > a.ts - INTERVAL 60 SECONDS AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY a.event_id")
def rate_stream(spark, sf):
    """The budget's windows over the events as a stream, with state; attempts of one time go by their ids."""
    from winnow.sources import store
    from winnow.streaming import budget

    at = f"{store.folder(spark)}/winnow/rate-{uuid.uuid4().hex}"
    return budget.decided(I.vattempts(spark, sf, stream=True), at).select("event_id", "requests", "window_tokens")


@query(I.sql("vattempts") + "SELECT event_id, free_at FROM (SELECT event_id, lag(ts, 19) OVER (PARTITION BY search ORDER BY ts, event_id) + INTERVAL 60 SECONDS AS free_at FROM vattempts)")
def rpm_wait(spark, sf):
    """By twenty requests a minute: no search of the tables has 1,200. Attempts that are free at once have a row too."""
    return B.request_wait(I.vattempts(spark, sf), most=20).select("event_id", "free_at")


@query(I.sql("vattempts") + "SELECT event_id, coalesce(ts < max(CASE WHEN status = 429 THEN ts + INTERVAL 3600 SECONDS END) OVER (PARTITION BY search ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS paused FROM vattempts")
def cooldown(spark, sf):
    return B.cooldown(I.vattempts(spark, sf), 3600).select("event_id", "paused")


@query(I.sql("vattempts") + "SELECT event_id, search FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY ts, event_id) AS n FROM vattempts) WHERE n <= 50000")
def request_cap(spark, sf):
    return B.request_cap(I.vattempts(spark, sf), LIMITS.requests).select("event_id", "search")


@query()
def search_report(spark, sf):
    """The whole search over the driver's documents as files, scored by their ids; one JSON a file."""
    from winnow.plans import search
    from winnow.plans.scorers import SqlScorer

    files = I.vfiles(spark, sf).select("path", "text")
    p = F.pmod(F.xxhash64("path", "name", "stage"), F.lit(1000)) / 1000.0
    return search.report(search.Search(files, "which of these?", SqlScorer(p)).run(100))


@query()
def ask_record(spark, sf):
    """Two questions over each conversation's turns; one JSON a conversation."""
    from winnow.plans import ask
    from winnow.plans.scorers import SqlScorer

    turns = I.vask(spark, sf)
    files = turns.select("call", "ord", F.concat_ws("/", "role", F.col("ord").cast("string")).alias("path"), F.sha2("text", 256).alias("identity"), "text")
    p = F.pmod(F.xxhash64("path", "name"), F.lit(1000)) / 1000.0
    return ask.record(files, ask.ask(files, ["Is it a question?", "Is it polite?"], SqlScorer(p)))
