"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracite.llm import audio, chat, languages, licenses, merkle, middle, mixing, packing, private, quality, repetition, sharding, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.with_paths(table(spark, sf_dir, "documents")))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.apply_rules(table(spark, sf_dir, "documents"))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(table(spark, sf_dir, "documents"))


def op6_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digest(private.find_private(table(spark, sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    # Spark cannot move the queries' filter before the rendering, so only they are rendered a second time.
    asked = audio.render(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return audio.align(audio.render(vectors, "vec_id", "embedding"), audio.excerpts(asked))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("text_hash")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified()(table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_chats(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.transform(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_shards": op2_shards,
    "op3_simhash": op3_simhash,
    "op4_repetition": op4_repetition,
    "op5_languages": op5_languages,
    "op6_private": op6_private,
    "op7_packing": op7_packing,
    "op8_audio": op8_audio,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_merkle": op11_merkle,
    "op12_chat": op12_chat,
    "op13_middle": op13_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.scan_sql(),
    "op10_mixing": mixing.MIX_SQL,
    "op11_merkle": merkle.merkle_sql(),
    "op12_chat": chat.CHAT_SQL,
    "op13_middle": middle.MIDDLE_SQL,
}
