"""A corpus pipeline: language ID, near-duplicates, personal data, source mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and is the next one's docs. All but the last
return the columns of docs; the last returns one row per piece of a packed sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import jaccard, langid, mixing, packing, pii
from marginalia.llm.common import BATCH, materialise


def _small_batches(spark: SparkSession) -> None:
    """From now on, texts go to Python and back in batches of BATCH bytes: an executor holds several of them outside of its heap, each up to twice as large while it grows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang becomes what was identified. Rejected ones, null and letterless texts included, go.

    Without a labelled document there is nothing to identify by, and that is an error, unless
    there is no document at all: losing the whole corpus silently would be worse.
    """
    _small_batches(spark)
    model = langid.learn(docs)
    if model is None and docs.limit(1).count():
        raise ValueError("no document has a language to learn from")
    named = langid.identify(docs, model, docs.columns)
    return named.filter("NOT rejected").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.75 Jaccard similarity connect, that with the smallest doc_id; documents without words stay."""
    _small_batches(spark)
    return jaccard.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced and n_chars, where there is one, brought up to date."""
    _small_batches(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the Poisson draw for their source's rate says, in a shuffled order."""
    _small_batches(spark)
    return mixing.poisson_replicate(docs, mixing.temperature_rates(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier and a tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is a table in the shared folder, so a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
