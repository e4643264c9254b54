"""Queries over scalar functions, names, trees and content."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import bytes as B
from winnow.functions import content as C
from winnow.functions import paths as P
from winnow.functions import text as X
from winnow.functions import times as T
from winnow.operators import names as N
from winnow.limits import LIMITS
from winnow.plans import inputs as I
from winnow.plans.catalog import query
from winnow.sources import filetree, store, treewriter

# Literal rows that the driver's tables lack
PATHS = ("a/b.rs", "a/.bashrc", "a.tar.gz", "Makefile", "x/y.py", "x/y.pyi", "t/a.tsx", "t/b.mjs", "g/main.go", "v1.2/readme", ".git/config", "src/.env", "src/.ENV.local", "node_modules/x/index.js", "docs/cert.PEM", "docs/keys.txt", "src/.envrc", "a/vendor/b.go", ".github/ci.yml", "build/out.o", "docs/CVS/Root", "src/credentials", "src/id_rsa")
MESSY = ("/a/b/../c", "/a/./b//c", "/../x", "/", "/a/..", "/a/b/../../c/./d", "/x/..y/...", "/a//../b/")
CONTENT = ((-1, "a\u0000b"), (-2, "\u001b[0m"), (-3, "-----BEGIN RSA PRIVATE KEY-----\nx"), (-4, "tab\there\u000c\r\nfine"), (-5, "-----BEGIN PRIVATE KEY-----"), (-6, "-----BEGIN rsa PRIVATE KEY-----"), (-7, "\u007f"))
RETRIES = ("1", "0", "2.5", "-1", "soon", "1e3", "1e400", "NaN", "", "18446744073709551615")


def sql_text(s: str) -> str:
    """A SQL literal; control characters by chr()."""
    parts, plain = [], ""
    for c in s:
        if ord(c) < 32 or ord(c) == 127:
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    return " || ".join([*parts, f"'{plain}'"])


def sql_values(rows) -> str:
    return ", ".join("(" + ", ".join(sql_text(x) if isinstance(x, str) else str(x) for x in (r if isinstance(r, tuple) else (r,))) + ")" for r in rows)


def literals(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def paths_of(spark: SparkSession, sf: str) -> DataFrame:
    return I.vfiles(spark, sf).select("path").unionByName(literals(spark, PATHS, "path string"))


ALL_PATHS = I.sql("vfiles") + f", paths AS (SELECT path FROM vfiles UNION ALL SELECT * FROM (VALUES {sql_values(PATHS)}) t(path)) "


@query("SELECT doc_id, sha256(text) AS value FROM documents")
def sha256(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S.%fZ') AS value FROM events")
def utc_stamp(spark, sf):
    return I.table(spark, sf, "events").select("event_id", T.utc_stamp(F.col("ts")).alias("value"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS value FROM events")
def rfc3339(spark, sf):
    return I.table(spark, sf, "events").select("event_id", T.rfc3339(F.col("ts")).alias("value"))


@query("SELECT event_id, round(value * 10) / 10 AS value FROM events")
def duration(spark, sf):
    return I.table(spark, sf, "events").select("event_id", T.tenths(F.col("value")).alias("value"))


@query(ALL_PATHS + r"SELECT path, regexp_extract(string_split(path, '/')[-1], '^.+(\.[^.]*)$', 1) AS value FROM paths")
def extension(spark, sf):
    return paths_of(spark, sf).select("path", P.extension(F.col("path")).alias("value"))


@query(ALL_PATHS + "SELECT path, CASE WHEN path NOT LIKE '%.%' THEN 'text' WHEN string_split(path, '.')[-1] IN ('py', 'pyi') THEN 'python' WHEN string_split(path, '.')[-1] IN ('ts', 'cts', 'mts', 'js', 'cjs', 'mjs', 'tsx', 'jsx') THEN 'typescript' WHEN string_split(path, '.')[-1] = 'go' THEN 'go' WHEN string_split(path, '.')[-1] = 'rs' THEN 'rust' ELSE 'text' END AS value FROM paths")
def language_mode(spark, sf):
    return paths_of(spark, sf).select("path", P.language(F.col("path")).alias("value"))


@query(I.sql("vfiles") + "SELECT doc_id, strlen(to_json({'path': path, 'text': text})::VARCHAR)::BIGINT AS value FROM vfiles")
def json_len(spark, sf):
    return I.vfiles(spark, sf).select("doc_id", X.json_bytes(F.col("path"), F.col("text")).alias("value"))


@query(ALL_PATHS + "SELECT path, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') AS value FROM paths")
def sanitize_label(spark, sf):
    return paths_of(spark, sf).select("path", X.sanitize_label(F.col("path")).alias("value"))


@query("SELECT item_id, '''' || replace(text || ' it''s', '''', '''\\''''') || '''' AS value FROM benchmark")
def shell_quote(spark, sf):
    return I.table(spark, sf, "benchmark").select("item_id", X.shell_quote(F.concat("text", F.lit(" it's"))).alias("value"))


@query(r"SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[_\p{L}\p{Nl}][_\p{L}\p{N}]*')) AS value FROM benchmark")
def tokens(spark, sf):
    return I.table(spark, sf, "benchmark").select("item_id", F.explode(X.identifiers(F.col("text"))).alias("value"))


@query("SELECT doc_id, left(text, (SELECT max(c) FROM range(0, least(length(text), 1000) + 1) t(c) WHERE strlen(left(text, c)) <= 1000)) AS head, right(text, (SELECT max(c) FROM range(0, least(length(text), 1000) + 1) t(c) WHERE strlen(right(text, c)) <= 1000)) AS tail FROM documents")
def clip_bytes(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", B.clip_head(F.col("text"), 1000).alias("head"), B.clip_tail(F.col("text"), 1000).alias("tail"))


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 3 THEN string_split(text, chr(10))[2] END AS value FROM documents")
def byte_slice(spark, sf):
    first = F.octet_length(F.substring_index("text", "\n", 1)) + 1
    end = F.octet_length(F.substring_index("text", "\n", 2))
    return I.table(spark, sf, "documents").select("doc_id", F.when(F.size(F.split("text", "\n", -1)) >= 3, B.slice_bytes(F.col("text"), first, end)).alias("value"))


@query(I.sql("vfiles") + "SELECT doc_id, least(bytes + 512 + 32 * (1 + doc_id % 64), 65536)::BIGINT AS value FROM vfiles")
def token_estimate(spark, sf):
    return I.vfiles(spark, sf).select("doc_id", X.token_estimate(F.col("bytes"), 1 + F.col("doc_id") % 64).alias("value"))


NORMAL = "list_reduce(string_split({p}, '/'), lambda a, p: CASE WHEN p = '' OR p = '.' THEN a WHEN p = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || p END, '')"


@query(f"SELECT path, CASE WHEN v = '' THEN '/' ELSE v END AS value FROM (SELECT path, {NORMAL.format(p='path')} AS v FROM (VALUES {sql_values(MESSY)}) t(path))")
def normalize_path(spark, sf):
    return literals(spark, MESSY, "path string").select("path", P.normalize(F.col("path")).alias("value"))


@query(f"SELECT page_id, CASE WHEN v = '' THEN '/' ELSE v END AS value FROM (SELECT page_id, {NORMAL.format(p='url_decode(p)')} AS v FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') || '/a+b%20c' AS p FROM pages))")
def uri_path(spark, sf):
    uri = F.concat(F.regexp_replace("url", "^[a-z]+://[^/]*", "file://localhost"), F.lit("/a+b%20c"))
    return I.table(spark, sf, "pages").select("page_id", P.uri_path(uri).alias("value"))


@query(f"SELECT header, CASE WHEN x >= 0 AND isfinite(x) THEN x END AS value FROM (SELECT header, TRY_CAST(header AS DOUBLE) AS x FROM (VALUES {sql_values(RETRIES)}) t(header))")
def retry_after(spark, sf):
    return literals(spark, RETRIES, "header string").select("header", X.retry_after(F.col("header")).alias("value"))


@query("SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k, (props->>'$.missing') AS missing FROM events")
def json_extract(spark, sf):
    return I.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(f"SELECT failure, code FROM (VALUES {sql_values(X.FAILURE_CODES.items())}) t(failure, code)")
def failure_codes(spark, sf):
    return literals(spark, X.FAILURE_CODES, "failure string").select("failure", X.failure_code(F.col("failure")).alias("code"))


@query(I.sql("vattempts") + "SELECT event_id, status::INTEGER AS status, CASE WHEN status = 200 THEN 'ok' WHEN status IN (429, 529) THEN 'retry' ELSE 'unavailable' END AS value FROM vattempts")
def classify_status(spark, sf):
    return I.vattempts(spark, sf).select("event_id", "status", X.status_class(F.col("status")).alias("value"))


@query(f"SELECT kind, code, skipped, stops FROM (VALUES {sql_values(X.ISSUES)}) t(kind, code, skipped, stops)")
def issue_dim(spark, sf):
    return literals(spark, X.ISSUES, "kind string, code string, skipped boolean, stops boolean")


@query("SELECT item_id, '{' || chr(10) || text || chr(10) || '} >' || '''/r/' || item_id || '/stdout.log'' 2>''/r/' || item_id || '/stderr.log''' AS value FROM benchmark")
def rewrite_text(spark, sf):
    return I.table(spark, sf, "benchmark").select("item_id", X.rewritten(F.col("text"), F.concat(F.lit("/r/"), F.col("item_id").cast("string"))).alias("value"))


@query("WITH e AS (SELECT event_id, strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S.%fZ') AS stamp, event_type AS label, row_number() OVER (PARTITION BY date_trunc('hour', ts), event_type ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, stamp || '-' || label || CASE WHEN n > 0 THEN '-' || n ELSE '' END AS value FROM e WHERE n < 1000")
def record_ids(spark, sf):
    e = I.table(spark, sf, "events").select("event_id", T.utc_stamp(F.date_trunc("hour", "ts")).alias("stamp"), F.col("event_type").alias("label"))
    return N.record_names(e, "event_id").select("event_id", F.col("name").alias("value"))


# Trees and names


@query(I.sql("ventries") + "SELECT path, kind, depth FROM ventries ORDER BY path")
def list_tree(spark, sf):
    return I.ventries(spark, sf).select("path", "kind", "depth").orderBy("path")


@query(I.sql("ventries", recursive=True) + ", r(path, depth) AS (SELECT '', 0::BIGINT UNION ALL SELECT v.path, r.depth + 1 FROM r JOIN ventries v ON v.parent = r.path WHERE v.path <> '') SELECT path, depth FROM r WHERE path <> ''")
def tree_closure(spark, sf):
    return N.closure(I.ventries(spark, sf))


RULE_DIR = "CASE WHEN name = '.winnow' THEN 'protected' WHEN name IN ('.git', '.hg', '.svn', '.bzr') THEN 'hidden' WHEN name LIKE '.%' THEN 'hidden' WHEN name IN ('_darcs', 'CVS') THEN 'vcs' WHEN name IN ('node_modules', 'vendor', 'venv', '__pycache__', 'dist', 'build', 'coverage', 'target') THEN 'dependency' WHEN lower(name) IN ('credentials', 'credentials.json', 'secrets.json', 'secrets.yaml', 'secrets.yml', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519') OR regexp_matches(lower(name), '[.](pem|key|p12|pfx)$') THEN 'sensitive_name' WHEN regexp_matches(path, '^src1(/|$)') THEN 'exclude_pattern' END"
RULE_FILE = "CASE WHEN name = '.winnow' THEN 'protected' WHEN name LIKE '.%' THEN 'hidden' WHEN lower(name) IN ('credentials', 'credentials.json', 'secrets.json', 'secrets.yaml', 'secrets.yml', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519') OR regexp_matches(lower(name), '[.](pem|key|p12|pfx)$') THEN 'sensitive_name' WHEN regexp_matches(path, '^src1/') THEN 'exclude_pattern' WHEN NOT regexp_matches(path, '[.](txt|js|go|rs)$') THEN 'not_included' END"
DIRS = "dirs AS (SELECT path FROM ventries WHERE kind = 'directory' UNION ALL SELECT * FROM (VALUES ('.git'), ('docs/CVS'), ('node_modules'), ('a/vendor'), ('x/.cache'), ('.github'), ('build'), ('src/ok'), ('p/secrets.json'), ('src1/deep'))  t(path))"
DIR_LITERALS = (".git", "docs/CVS", "node_modules", "a/vendor", "x/.cache", ".github", "build", "src/ok", "p/secrets.json", "src1/deep")


def some_dirs(spark, sf):
    return I.ventries(spark, sf).where("kind = 'directory'").select("path").unionByName(literals(spark, DIR_LITERALS, "path string"))


@query(I.sql("ventries") + ", " + DIRS + f" SELECT path, {RULE_DIR} AS reason FROM (SELECT path, string_split(path, '/')[-1] AS name FROM dirs)")
def exclude_dirs(spark, sf):
    return some_dirs(spark, sf).select("path", N.directory_reason(F.col("path"), exclude=["src1/**"], protected=[".winnow"]).alias("reason"))


@query(ALL_PATHS + f"SELECT path, {RULE_FILE} AS reason FROM (SELECT path, string_split(path, '/')[-1] AS name FROM paths)")
def exclude_files(spark, sf):
    return paths_of(spark, sf).select("path", N.file_reason(F.col("path"), include=["**/*.txt", "**/*.js", "**/*.go", "**/*.rs"], exclude=["src1/**"], protected=[".winnow"]).alias("reason"))


@query(ALL_PATHS + f"SELECT reason, count(*) AS n FROM (SELECT {RULE_FILE} AS reason FROM (SELECT path, string_split(path, '/')[-1] AS name FROM paths)) WHERE reason IS NOT NULL GROUP BY reason")
def exclusion_counts(spark, sf):
    return exclude_files(spark, sf).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(I.sql("vfiles") + "SELECT path FROM vfiles WHERE regexp_matches(path, '^src1[^/]*/(.*/)?[^/]*7[.]txt$') OR regexp_matches(path, '^(.*/)?fr/[^/]*[.]txt$')")
def include_globs(spark, sf):
    return I.vfiles(spark, sf).where(N.any_glob(F.col("path"), ["src1*/**/*7.txt", "**/fr/*.txt"])).select("path")


@query(I.sql("vfiles") + "SELECT path FROM vfiles WHERE NOT regexp_matches(path, '^src2/') AND NOT regexp_matches(path, '^(.*/)?de/[^/]*$') AND NOT regexp_matches(path, '^src[34]/[^/]*/[^/]5[.]txt$')")
def exclude_globs(spark, sf):
    return I.vfiles(spark, sf).where(~N.any_glob(F.col("path"), ["src2/**", "**/de/*", "src[34]/*/?5.txt"])).select("path")


@query(f"SELECT name, (lower(name) IN ('credentials', 'credentials.json', 'secrets.json', 'secrets.yaml', 'secrets.yml', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', '.netrc', '.npmrc', '.pypirc', '.env') OR lower(name) LIKE '.env.%' OR regexp_matches(lower(name), '[.](pem|key|p12|pfx)$')) AS hit FROM (SELECT DISTINCT string_split(path, '/')[-1] AS name FROM (VALUES {sql_values(PATHS)}) t(path))")
def sensitive_names(spark, sf):
    return literals(spark, PATHS, "path string").select(P.basename(F.col("path")).alias("name")).distinct().select("name", P.is_sensitive(F.col("name")).alias("hit"))


@query(I.sql("vfiles") + "SELECT path, root FROM (SELECT v.path, r.root, row_number() OVER (PARTITION BY v.path ORDER BY length(r.root) DESC) AS n FROM vfiles v JOIN (VALUES ('src1'), ('src1/fr'), ('src7'), ('src1/f')) r(root) ON v.path = r.root OR starts_with(v.path, r.root || '/')) WHERE n = 1")
def root_containment(spark, sf):
    return N.containing_root(I.vfiles(spark, sf).select("path"), ["src1", "src1/fr", "src7", "src1/f"])


# Every 50th file and the directory of every seventh are roots; a root may be a file.
@query(I.sql("vfiles") + ", r AS (SELECT path AS root FROM vfiles WHERE doc_id % 50 = 0 UNION SELECT dir FROM vfiles WHERE doc_id % 7 = 0 AND doc_id % 3 = 0 UNION SELECT source FROM vfiles WHERE doc_id % 11 = 0) SELECT v.path, max(r.root) AS root FROM (SELECT DISTINCT path, dir, source FROM vfiles) v LEFT JOIN r ON r.root IN (v.path, v.dir, v.source) AND length(r.root) = (SELECT max(length(x.root)) FROM r x WHERE x.root IN (v.path, v.dir, v.source)) GROUP BY v.path")
def nearest_roots(spark, sf):
    """The root that holds each file most closely, with the roots from a table."""
    files = I.vfiles(spark, sf)
    roots = files.where("doc_id % 50 = 0").select(F.col("path").alias("root"))
    roots = roots.union(files.where("doc_id % 7 = 0 AND doc_id % 3 = 0").select("dir")).union(files.where("doc_id % 11 = 0").select(F.substring_index("dir", "/", 1)))
    return N.nearest_roots(files, roots)


# Content

WITH_LITERALS = f"WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {sql_values(CONTENT)}) t(doc_id, text)) "
BINARY_SQL = r"regexp_matches(text, '[\x00-\x08\x0B\x0E-\x1F\x7F]')"


def with_literals(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", "text").unionByName(literals(spark, CONTENT, "doc_id long, text string"))


@query(WITH_LITERALS + f"SELECT doc_id, {BINARY_SQL} AS hit FROM d")
def binary_filter(spark, sf):
    return with_literals(spark, sf).select("doc_id", C.is_binary(F.col("text")).alias("hit"))


@query(WITH_LITERALS + "SELECT doc_id, true AS hit FROM d UNION ALL SELECT * FROM (VALUES (-10, false), (-11, true), (-12, false)) t(doc_id, hit)")
def utf8_filter(spark, sf):
    raw = literals(spark, [(-10, bytearray(b"caf\xe9")), (-11, bytearray("café".encode())), (-12, bytearray(b"\xff\xfe"))], "doc_id long, raw binary")
    rows = with_literals(spark, sf).select("doc_id", F.col("text").cast("binary").alias("raw")).unionByName(raw)
    return rows.select("doc_id", C.is_utf8(F.col("raw")).alias("hit"))


@query(WITH_LITERALS + "SELECT doc_id, regexp_matches(text, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----') AS hit FROM d")
def private_key_filter(spark, sf):
    return with_literals(spark, sf).select("doc_id", C.has_private_key(F.col("text")).alias("hit"))


@query(WITH_LITERALS + f"SELECT doc_id, CASE WHEN strlen(text) > 16777216 THEN 'size_limit' WHEN {BINARY_SQL} THEN 'binary' WHEN regexp_matches(text, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----') THEN 'private_key' ELSE 'ok' END AS status, sha256(text) AS sha256, strlen(text)::BIGINT AS bytes FROM d")
def snapshot_scan(spark, sf):
    t = F.col("text")
    return with_literals(spark, sf).select("doc_id", C.read_status(t, F.is_valid_utf8(t.cast("binary")), B.byte_length(t), LIMITS.file_bytes).alias("status"), F.sha2(t, 256).alias("sha256"), B.byte_length(t).alias("bytes"))


TREE = I.sql("vfiles") + f", d AS (SELECT path, coalesce(text, '') AS text FROM vfiles UNION ALL SELECT 'literal/' || doc_id || '.txt', text FROM (VALUES {sql_values(CONTENT)}) t(doc_id, text)), s AS (SELECT path, text, CASE WHEN strlen(text) > 16777216 THEN 'size_limit' WHEN {BINARY_SQL} THEN 'binary' WHEN regexp_matches(text, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----') THEN 'private_key' ELSE 'ok' END AS status FROM d) "


@query(TREE + "SELECT path, regexp_replace(path, '/[^/]*$', '') AS parent, (len(path) - len(replace(path, '/', '')) + 1)::INT AS depth, strlen(text)::BIGINT AS bytes, status, CASE status WHEN 'ok' THEN sha256(text) END AS sha256 FROM s")
def tree_scan(spark, sf):
    """Every document written as a file of a tree, in one commit, and found again by the scan of the
    tree with its filters pushed down. The tree stands in the session's shared folder, which executors
    must have mounted, and goes when the scan is written."""
    held = literals(spark, CONTENT, "doc_id long, text string").select(F.format_string("literal/%d.txt", "doc_id").alias("path"), "text")
    root = store.qualified(spark, f"{store.folder(spark)}/winnow/tree-{uuid.uuid4().hex}")
    filetree.register(spark)
    try:
        I.vfiles(spark, sf).select("path", "text").unionByName(held).write.format("winnow_files").mode("append").save(root)
        files = spark.read.format("winnow_files").option("path", root).load().where("kind = 'file' AND reason IS NULL")
        return store.written(files.select("path", "parent", "depth", "bytes", "status", "sha256"), "tree-scan")
    finally:
        treewriter.remove(spark, root)
