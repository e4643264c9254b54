"""From raw documents to packed training sequences, in five stages.

Every stage but the last returns the columns of ``documents``. A stage's result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow import session
from winnow.llm import jaccard, mixing, packing, quality, secrets
from winnow.llm.base import durable

#: Rows of 32-character hashes that may be sent to every executor, about 20 MB.
BROADCAST_ROWS = 200_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def with_key(docs: DataFrame) -> DataFrame:
    """The whole row as ``row`` and its MD5, nulls told apart from texts, as ``key``.

    doc_id may be null or repeated; the key is neither but for rows that are equal in every column. That
    two other rows agree in 128 bits is left out of account (10**12 rows: less than 10**-14). Within
    the struct, no column of the table meets a name used here.
    """
    row = F.struct(*docs.columns)
    return docs.select(row.alias("row"), F.md5(F.to_json(row, {"ignoreNullFields": "false"}).cast("binary")).alias("key"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects, by their whole texts.

    Null and empty texts score the share of good labels. Equal texts share a fate, repeated rows stay
    repeated; ties at the threshold are kept. Texts of any length are read whole. An empty table stays
    empty; all columns pass through.
    """
    session.ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five words to a shingle, similarity 0.8 or more.

    The one whose row hash is least stays. Rows without words (null, empty, white space) are no one's
    copy, but of rows equal in every column one stays. Texts of any length are compared whole, all columns
    come through whatever their names. An empty table stays empty.
    """
    session.ship(spark)
    rows = with_key(docs)
    found = jaccard.components(rows.select(F.col("key").alias("doc_id"), "row.text"), words=5, num=80, den=100)
    per = found.groupBy(F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("first"))
    per = durable(per.where("NOT first OR rows > 1"), "pipeline-copies", few_files=True)
    return without(rows, per).select("row.*")


def without(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` without those that are not ``first``, and once each of those that ``per`` has more of.

    ``per`` goes to every executor if it has at most BROADCAST_ROWS rows (of a hash each), so that no
    text is shuffled; else both sides are shuffled by the hash.
    """
    sent = F.broadcast if per.count() <= BROADCAST_ROWS else lambda df: df
    left = rows.join(sent(per.select("key")), "key", "left_anti")
    if per.where("first").isEmpty():
        return left
    return left.unionByName(rows.join(sent(per.where("first").select("key")), "key", "left_semi").dropDuplicates(["key"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the secrets in the whole texts; every row stays, in its columns.

    Null texts stay null, repeated rows are treated alike, texts of any length are read whole, columns of any
    name come through, an empty table stays empty.
    """
    return secrets.redact(docs, secrets.made_model(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their shares, in training order.

    Each reading is a row, where the curriculum puts it. Null sources form one source, null texts have
    no words. Rows equal in every column are told apart by their places alone; ties in place go by
    the row's hash. Texts of any length are read whole, columns of any name come through. An empty table
    stays empty.
    """
    rows = with_key(docs)
    mixed = mixing.mix(rows.select(F.col("key").alias("doc_id"), "row.source", "row.text"))
    readings = durable(mixed.select(F.col("doc_id").alias("key"), F.explode("positions").alias("position")), "pipeline-readings", few_files=True)
    repeats = durable(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pipeline-repeats", few_files=True)
    once = rows if repeats.isEmpty() else rows.join(repeats, "key", "left_anti").unionByName(rows.join(repeats, "key", "left_semi").dropDuplicates(["key"]))
    return once.join(readings, "key").orderBy("position", "key").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences along the curriculum; one row per piece.

    The rows of the mixing's files stand in training order. They are packed block after block of it, along the
    curve within a block only, so that sequences follow the schedule and a document's readings
    stay as far apart as the schedule has them. Rows that come from no file have no such order and are
    packed along the curve alone. Null and empty texts are an end id each; repeated rows and null ids are
    packed each on its own; texts of any length are cut over sequences; other columns are ignored. An
    empty table gives no pieces.
    """
    session.ship(spark)
    try:
        at = docs.metadataColumn("_metadata")
        order = [at["file_name"], at["row_index"]]
        docs.select(*order)
    except AnalysisException:
        order = None
    return packing.pack(docs, TOKENIZER, order=order)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned classifiers and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
