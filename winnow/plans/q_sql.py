"""Queries by the functions that SQL texts name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from winnow import sql as S
from winnow.plans import inputs as I
from winnow.plans.catalog import query
from winnow.plans.q_basic import BINARY_SQL
from winnow.plans.q_lines import ALL_UNITS


def by_text(spark: SparkSession, sf: str, name: str, text: str) -> DataFrame:
    """A SQL text over one table, which it names as {view}; the view has a name of its own and goes again."""
    S.register(spark)
    view = f"{name}_{uuid.uuid4().hex}"
    I.table(spark, sf, name).createOrReplaceTempView(view)
    try:
        return spark.sql(text.replace("{view}", view))
    finally:
        spark.catalog.dropTempView(view)


@query(I.sql("vfiles") + f", d AS (SELECT vfiles.*, d.lang FROM vfiles JOIN documents d USING (doc_id)) SELECT doc_id, '.txt' AS extension, 'text' AS language, dir AS parent, 3::BIGINT AS depth, CASE WHEN bytes > 16777216 THEN 'size_limit' WHEN {BINARY_SQL} THEN 'binary' WHEN regexp_matches(text, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----') THEN 'private_key' ELSE 'ok' END AS status, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') AS label, '''' || replace(text, '''', '''\\''''') || '''' AS quoted, least(bytes + 512 + 32 * 3, 65536)::BIGINT AS tokens FROM d")
def sql_functions(spark, sf):
    """Every document as a file, by the functions' names in SQL."""
    path = "concat_ws('/', source, lang, concat(CAST(doc_id AS STRING), '.txt'))"
    text = f"SELECT doc_id, winnow_extension({path}) AS extension, winnow_language({path}) AS language, winnow_parent({path}) AS parent, winnow_depth({path}) AS depth, winnow_read_status(text) AS status, winnow_sanitize_label({path}) AS label, winnow_shell_quote(text) AS quoted, winnow_token_estimate(octet_length(text), 3) AS tokens FROM {{view}}"
    return by_text(spark, sf, "documents", text)


@query(I.sql("vlines", recursive=True) + ALL_UNITS)
def sql_text_units(spark, sf):
    """The pieces of every document by the table function; no shuffle."""
    return by_text(spark, sf, "documents", "SELECT * FROM winnow_text_units(TABLE(SELECT doc_id, text FROM {view}))")
