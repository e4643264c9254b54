"""The driver's tables seen as files, directories, scores, attempts and calls.

Each input has a DataFrame and, for the SQL side, a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import bytes as B
from winnow.functions import paths as P

PRIMES = (7919, 104_729, 1_299_709)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def path_of() -> Column:
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def vfiles(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file ``source/lang/doc_id.txt``."""
    return table(spark, sf, "documents").select("doc_id", path_of().alias("path"), F.concat_ws("/", "source", "lang").alias("dir"), "text", B.byte_length(F.col("text")).alias("bytes"))


def ventries(spark: SparkSession, sf: str) -> DataFrame:
    """Files and the distinct directories above them: path, kind, depth, parent."""
    files = vfiles(spark, sf).select("path", "dir")
    # a directory holds many files: distinct leaf directories first, their ancestors after
    leaves = files.select("dir").distinct()
    dirs = leaves.select(F.explode(F.concat(P.ancestors(F.col("dir")), F.array("dir"))).alias("path")).distinct()
    both = files.select("path", F.lit("file").alias("kind")).unionByName(dirs.select("path", F.lit("directory").alias("kind")))
    return both.select("path", "kind", P.depth(F.col("path")).alias("depth"), P.parent(F.col("path")).alias("parent"))


def score(prime: int) -> Column:
    return F.pmod(F.col("doc_id") * prime, F.lit(1000)) / F.lit(1000).cast("double")


def vscore(spark: SparkSession, sf: str) -> DataFrame:
    """Three scores of each document from its id."""
    return table(spark, sf, "documents").select("doc_id", path_of().alias("path"), F.concat_ws("/", "source", "lang").alias("dir"), *[score(p).alias(f"p{i + 1}") for i, p in enumerate(PRIMES)])


def vlines(spark: SparkSession, sf: str) -> DataFrame:
    from winnow.operators import lines

    return lines.line_offsets(table(spark, sf, "documents"))


def vspans(spark: SparkSession, sf: str) -> DataFrame:
    """For every third line n, the byte span of lines n-1 to n+1: doc_id, n, span_start, span_end."""
    rows = vlines(spark, sf).select("doc_id", "line_no", "byte_start", "byte_end")
    around = rows.select("doc_id", F.explode(F.array(F.col("line_no") - 1, F.col("line_no"), F.col("line_no") + 1)).alias("n"), "byte_start", "byte_end").where("n >= 3 AND n % 3 = 0")
    last = rows.groupBy("doc_id").agg(F.max("line_no").alias("last"))
    spans = around.groupBy("doc_id", "n").agg(F.min("byte_start").alias("span_start"), F.max("byte_end").alias("span_end"))
    return spans.join(last, "doc_id").where("n <= last").drop("last")


def vattempts(spark: SparkSession, sf: str, stream: bool = False) -> DataFrame:
    events = table(spark, sf, "events")
    if stream:
        # a pattern, as a stream takes a plain path for a folder and the table may be one file
        events = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    status = F.when(F.col("event_type") == "error", 529).when(F.col("event_type") == "signup", 429).when(F.col("event_type") == "purchase", 500).otherwise(200)
    return events.select("event_id", F.col("user_id").alias("search"), "ts", F.floor(F.col("value") * 1000).cast("long").alias("tokens"), status.alias("status"))


def vask(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("call"), F.col("turn").alias("ord"), "role", "text", B.byte_length(F.col("text")).alias("bytes"))


SQL = {
    "vfiles": "vfiles AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir, source, text, strlen(text)::BIGINT AS bytes FROM documents)",
    "ventries": "ventries AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, 'file' AS kind, 3::BIGINT AS depth, source || '/' || lang AS parent FROM documents UNION ALL SELECT DISTINCT source || '/' || lang, 'directory', 2, source FROM documents UNION ALL SELECT DISTINCT source, 'directory', 1, '' FROM documents)",
    "vscore": "vscore AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir, " + ", ".join(f"((doc_id * {p}) % 1000) / CAST(1000 AS DOUBLE) AS p{i + 1}" for i, p in enumerate(PRIMES)) + " FROM documents)",
    "vlines": "vl AS (SELECT doc_id, strlen(text)::BIGINT AS size, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents), vlines AS (SELECT doc_id, line_no, line, (sum(strlen(line) + 1) OVER w - strlen(line) - 1)::BIGINT AS byte_start, least(sum(strlen(line) + 1) OVER w, size)::BIGINT AS byte_end FROM vl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))",
    "vattempts": "vattempts AS (SELECT event_id, user_id AS search, ts, CAST(floor(value * 1000) AS BIGINT) AS tokens, CASE event_type WHEN 'error' THEN 529 WHEN 'signup' THEN 429 WHEN 'purchase' THEN 500 ELSE 200 END AS status FROM events)",
    "vask": "vask AS (SELECT conv_id AS call, turn AS ord, role, text, strlen(text)::BIGINT AS bytes FROM conversations)",
}
SQL["vspans"] = SQL["vlines"] + ", vspans AS (SELECT a.doc_id, a.line_no AS n, min(b.byte_start) AS span_start, max(b.byte_end) AS span_end FROM vlines a JOIN vlines b ON a.doc_id = b.doc_id AND abs(a.line_no - b.line_no) <= 1 WHERE a.line_no % 3 = 0 GROUP BY ALL)"


def sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in names) + " "
