"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, embeddings, jaccard, langid, media, mixing, negatives, packing, pii, rules, scoring, warc
from .common import table


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    return chat.conversation_digests(chat.format_records(records, "record", ["conv_id", "turn"]))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_features(table(spark, sf_dir, "documents"), keep_media=False)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 4, 2)
    return langid.identify(docs.withColumn("held_out", held), langid.learn(docs, ~held), ["doc_id", "held_out"])


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.store_and_read(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), langid.held_out("doc_id", 7, 2))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.poisson_replicate(docs, mixing.temperature_rates(docs))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", own), F.col("vec_id") % 50 == 0)


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_chat": op1_chat, "op2_audio": op2_audio, "op3_language": op3_language, "op4_warc": op4_warc, "op5_packing": op5_packing, "op6_jaccard": op6_jaccard, "op7_pii": op7_pii, "op8_scoring": op8_scoring, "op9_embeddings": op9_embeddings, "op10_mixing": op10_mixing, "op11_align": op11_align, "op12_negatives": op12_negatives, "op13_rules": op13_rules}
ORACLES: dict[str, str] = {
    "op10_mixing": mixing.ORACLE,
    "op12_negatives": negatives.ORACLE,
    "op13_rules": rules.oracle(),
    "op4_warc": """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first, count(*) AS n FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, url, payload_bytes, d.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
""",
}
