"""The functions by name in SQL, against the column functions and the queries."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from winnow import sql
from winnow.functions import bytes as B
from winnow.functions import content as C
from winnow.functions import paths as P
from winnow.functions import text as X
from winnow.limits import LIMITS


def same():
    """Calls in SQL and the columns that they stand for."""
    t = F.col("t")
    return {
        "winnow_extension(t)": P.extension(t), "winnow_language(t)": P.language(t), "winnow_parent(t)": P.parent(t), "winnow_depth(t)": P.depth(t),
        "winnow_is_sensitive(t)": P.is_sensitive(t), "winnow_is_binary(t)": C.is_binary(t), "winnow_has_private_key(t)": C.has_private_key(t),
        "winnow_read_status(t)": C.read_status(t, F.is_valid_utf8(t), F.octet_length(t), LIMITS.file_bytes),
        "winnow_sanitize_label(t)": X.sanitize_label(t), "winnow_shell_quote(t)": X.shell_quote(t), "winnow_identifiers(t)": X.identifiers(t),
        **{f"winnow_clip(t, {n})": B.clip_head(t, n) for n in (0, 1, 2, 5, 9)},
        "winnow_byte_slice(t, 0, 0)": B.slice_bytes(t, F.lit(0), F.lit(0)), "winnow_retry_after(t)": X.retry_after(t), "winnow_failure_code(t)": X.failure_code(t),
        "winnow_token_estimate(octet_length(t), 2)": X.token_estimate(F.octet_length(t), F.lit(2)),
    }


PIECES = st.sampled_from(["a", "é", "漢", "😀", "/", ".", "'", "\\", ".env", ".env.x", "id_rsa", "A.PEM", "b.py", "c.tsx", "_x1", " ", "\n", "\x07", "1.5", "-1", "inf", "nan", "1e400", "overloaded", "-----BEGIN PRIVATE KEY-----"])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=1, max_size=40))
def test_functions_say_what_the_columns_say(spark, texts):
    sql.register(spark)
    rows = spark.createDataFrame([(x,) for x in texts] + [(None,), (".env",), ("overloaded",), ("2.5",)], "t string")
    pairs = same()
    got = rows.select("t", *[F.expr(q).alias(f"s{i}") for i, q in enumerate(pairs)], *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())]).collect()
    for r in got:
        for i, q in enumerate(pairs):
            assert r[f"s{i}"] == r[f"c{i}"], (q, r.t)


def test_units_by_any_partitioning(spark, sf):
    want = sorted(map(tuple, entry.queries()["text_units"](spark, sf).collect()))
    sql.register(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("sql_docs")
    for clause in ("", " PARTITION BY doc_id"):
        got = spark.sql(f"SELECT * FROM winnow_text_units(TABLE(SELECT doc_id, text FROM sql_docs){clause})")
        assert sorted(map(tuple, got.collect())) == want
    odd = spark.sql("SELECT * FROM winnow_text_units(TABLE(SELECT * FROM VALUES (1L, CAST(NULL AS STRING)), (2L, ''), (3L, 'a'), (3L, 'a') AS v(doc_id, text)))")
    assert [tuple(r) for r in odd.collect()] == [(3, 0, 0, 1, 1, 1, False)] * 2


def test_filters_by_name_reach_the_scan(spark, sf):
    sql.register(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("sql_docs")
    plan = spark.sql("SELECT doc_id FROM sql_docs WHERE winnow_failure_code(lang) IS NULL AND winnow_token_estimate(doc_id, 0) < 600")._jdf.queryExecution().toString()
    assert "winnow_" not in plan.split("== Physical Plan ==")[1] and "Python" not in plan


@pytest.mark.parametrize("name", ["sql_functions", "sql_text_units"])
def test_queries_are_sql(name):
    assert name in entry.oracle_sql()
