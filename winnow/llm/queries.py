"""The queries of this subpackage, each a thin call of its operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import labelled, quality

    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = labelled.in_fold(F.col("doc_id"), quality.FOLDS)
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    mixed = mixing.mix_order(mixing.mix(table(spark, sf_dir, "documents")))
    # sorted by whole positions; what is shown is rounded, as SQL may differ in the last bit
    shown = lambda i: F.round(F.try_element_at("positions", F.lit(i)), 9)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shown(1).alias("position"), shown(2).alias("second_position"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.scan(table(spark, sf_dir, "documents"), secrets.made_model(spark))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import scoring

    return scoring.score(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.components(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import labelled, toxicity

    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = labelled.in_fold(F.col("doc_id"), toxicity.FOLDS)
    out = toxicity.classify(docs, chain)
    toxic = F.col("is_toxic").cast("int")
    return out.select("doc_id", held_out.alias("held_out"), F.col("p_toxic").alias("score"), toxic.alias("toxic"), toxic.alias("predicted"), "p_junk", "p_toxic")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.digest(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(table(spark, sf_dir, "embeddings"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.components(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import resampling

    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ranked

    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
