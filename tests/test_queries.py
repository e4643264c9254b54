"""Every query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, "nan" if isinstance(v, float) and math.isnan(v) else v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, db, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    order = ", ".join(f'"{c}"' for c in columns)
    rows = want.project(order).fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(rows, key=key)


def test_text_units_covers_every_byte(spark, tmp_path):
    """Every document with text, giant lines too, by brute force."""
    texts = ["", "short\n", "é" * 4_000, "a\n" + "漢x" * 3_000 + "\ntail\n" + "b\n" * 2_000, "y" * 3_000, "y" * 2_999 + "\nz"]
    at = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    want = []
    for i, t in enumerate(texts):
        raw, a, cuts = t.encode(), 0, []
        while a < len(raw):
            z = max((k for k in range(a + 1, min(len(raw), a + 3_000) + 1) if k == len(raw) or raw[k - 1 : k] == b"\n"), default=None) if len(raw) > a + 3_000 else len(raw)
            z = z or max(k for k in range(a + 1, a + 3_001) if raw[k] & 0xC0 != 0x80)
            cuts.append((a, z))
            a = z
        want += [(i, n, a, z, raw[:a].count(b"\n") + 1, raw.count(b"\n") + 1 if z == len(raw) else raw[: z - 1].count(b"\n") + 1, len(cuts) > 1) for n, (a, z) in enumerate(cuts)]
    columns = "doc_id ord byte_start byte_end start_line end_line partial".split()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(ORACLES["text_units"]).project(", ".join(columns)).fetchall()
    assert sorted(map(tuple, entry.queries()["text_units"](spark, at).select(*columns).collect())) == sorted(sql) == want


def test_search_status_counts_every_issue(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_type IN ('error', 'signup', 'purchase') AS bad").collect()
    bad = {r.user_id for r in e if r.bad}
    want = {r.user_id: "interrupted" if r.user_id % 10 == 0 else "incomplete" if r.user_id in bad else "complete" for r in e}
    assert {r.search: r.status for r in entry.queries()["search_status"](spark, sf).collect()} == want


def test_three_part_sample_shares_a_folder_s_characters(spark, tmp_path):
    """Two files in a folder have 80,000 characters each: what is no longer is whole, of others three parts stand."""
    whole, cut = "é" * 80_000, "".join(chr(97 + i % 26) for i in range(80_001))
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, whole, "en", "src"), (2, cut, "en", "src")], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    got = {r.doc_id: r.value for r in entry.queries()["three_part_sample"](spark, at).collect()}
    part = 80_000 // 3
    starts = (0, 80_001 // 2 - part // 2, 80_001 - part)
    assert got == {1: whole, 2: "\n...\n".join(f"[character offset {a}]\n{cut[a : a + part]}" for a in starts)}


def lined(spark, folder, *lines):
    """A table of documents 0, 1, 2... with so many lines of 100 bytes."""
    rows = [(i, "\n".join(["x" * 99] * n), "en", "src") for i, n in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def result(spark, name, at, *columns):
    return sorted(map(tuple, entry.queries()[name](spark, at).select(*columns).collect()))


def test_line_blocks_are_of_four_lines(spark, tmp_path):
    at = lined(spark, tmp_path, 9, 4)
    assert result(spark, "line_blocks", at, "doc_id", "block_start", "block_end") == [(0, 1, 4), (0, 5, 8), (0, 9, 9), (1, 1, 4)]


def test_excerpt_windows_are_around_blocks_of_four_lines(spark, tmp_path):
    at = lined(spark, tmp_path, 13)
    assert result(spark, "excerpt_windows", at, "block_start", "window_start", "window_end") == [(1, 1, 7), (5, 2, 11), (9, 6, 13), (13, 10, 13)]


def test_neighbours_are_blocks_of_four_lines(spark, tmp_path):
    at = lined(spark, tmp_path, 9)
    assert result(spark, "neighbours", at, "block_start", "previous", "next") == [(1, 0, 5), (5, 1, 9), (9, 5, 0)]


def test_comment_dedup_has_repeats_to_drop(spark, tmp_path):
    """Two whole blocks of four lines in the same eight lines are one row."""
    at = lined(spark, tmp_path, 18)
    assert result(spark, "comment_dedup", at, "start_line", "end_line") == [(0, 3), (1, 3), (2, 1)]


def test_group_context_is_around_a_group_beyond_1600_bytes(spark, tmp_path):
    at = lined(spark, tmp_path, 16, 29)
    got = result(spark, "group_context", at, "doc_id", "block_start", "kind", "opening_end", "near_start", "near_end")
    whole = [(0, a, "whole", 1599, 0, 0) for a in range(1, 17, 4)]
    around = [(1, a, "around", 2000, max(a - 9, 0) * 100, min(100 * min(a + 11, 29), 2899)) for a in range(1, 30, 4)]
    assert got == whole + around


def test_rpm_wait_has_times(spark, sf):
    """From the twentieth attempt of a search on there is a time, and every attempt has a row."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id").collect()
    per = {u: sum(r.user_id == u for r in e) for u in {r.user_id for r in e}}
    got = entry.queries()["rpm_wait"](spark, sf).collect()
    assert len(got) == len(e) and sum(r.free_at is not None for r in got) == sum(max(n - 19, 0) for n in per.values()) > 0


def test_what_a_model_would_be_asked(spark, tmp_path):
    """navigation_items and selection_questions against the functions of one file, and all units."""
    import hashlib

    from winnow.operators import sampled
    from winnow.plans.search import selection_units

    texts = ["short\n", "", "line of text\n" * 3_000, "x" * 40_000, "a\n" * 600, "漢\n" * 9_000]
    rows = [(i, t, "en" if i % 2 else "de", "src") for i, t in enumerate(texts)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    got = {r.path: r for r in entry.queries()["navigation_items"](spark, at).collect()}
    assert {p for p in got if got[p].kind == "directory"} == {"src", "src/de", "src/en"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for i, t, lang, _ in rows:
        shown = sampled.file_preview(f"src/{lang}/{i}.txt", t, "which of these?")["text"]
        r = got[f"src/{lang}/{i}.txt"]
        assert r.held and r.shown_sha256 == sha(shown) and r.shown_bytes == len(shown.encode())
    asked = entry.queries()["selection_questions"](spark, at).collect()
    want = sorted((f"src/{lang}/{i}.txt", n, s, sha(t.encode()[u.byte_start : u.byte_end].decode())) for i, t, lang, _ in rows for n, u in enumerate(selection_units("a.txt", t)) for s in ("relevance", "scope"))
    assert sorted((r.path, r.ord, r.stage, r.sha256) for r in asked) == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "score"] and df.count() > 0


def test_every_query_without_sql_is_known():
    assert set(entry.catalog.queries()) - set(ORACLES) <= {"search_report", "ask_record", "navigation_items", "selection_questions"}
