"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate; each document draws its number of copies
from a Poisson distribution with that mean by inverting the distribution function
at a uniform number hashed from its id; copies are exploded and shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A rate above this is drawn as a sum of independent draws of equal smaller rates, so exp(-rate) never underflows.
LARGEST_DRAW = 256
#: So many sources at most are broadcast; beyond, both sides are salted and joined by a shuffle.
MAX_BROADCAST_SOURCES = 100_000
SALTS = 64


def temperature_rates(docs: DataFrame, alpha: float = 0.7, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate): target weights are each source's share of characters to the power alpha, renormalised.

    alpha 1 keeps the mixture, 0 makes sources equal. The expected number of
    characters after mixing is epochs times that of the input. A source without
    any character keeps its documents at rate ``epochs``. Null is a source.
    """
    mass = _mass(docs, source, text)
    total = mass.agg(F.sum("__mass").alias("all"), F.sum(F.pow("__mass", F.lit(float(alpha)))).alias("norm")).first()
    rate = F.lit(float(epochs)) * F.lit(total["all"]) * F.pow("__mass", F.lit(float(alpha))) / F.lit(total["norm"]) / F.col("__mass")
    return mass.select("source", F.when(F.col("__mass") > 0, rate).otherwise(F.lit(float(epochs))).alias("rate"))


def _mass(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, __mass): characters of each source, as a table of its own, as it is used more than once."""
    return materialise(docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("double").alias("__mass")), "mass")


def weight_rates(docs: DataFrame, weights: dict[str, float], epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate) for stated target weights; a source that isn't listed gets rate 0."""
    spark = docs.sparkSession
    mass = _mass(docs, source, text)
    total = mass.agg(F.sum("__mass").alias("all")).first()
    asked = spark.createDataFrame([(k, float(v) / sum(weights.values())) for k, v in weights.items()], "source string, __w double")
    rate = F.lit(float(epochs)) * F.lit(total["all"]) * F.coalesce("__w", F.lit(0.0)) / F.col("__mass")
    return mass.join(F.broadcast(asked), "source", "left").select("source", F.when(F.col("__mass") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def _uniform(seed: int, key: Column, draw: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key, draw.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def _distribution(rates: DataFrame) -> DataFrame:
    """(__source, __draws, __cdf): P(N <= k) for k from 0, for one of the equal draws that make up a rate."""
    each = F.col("rate") / F.col("__draws")
    steps = F.ceil(F.col("__each") + 12 * F.sqrt("__each") + 30).cast("int")  # beyond, less than 1e-15 is left
    start = F.struct(F.exp(-F.col("__each")).alias("p"), F.exp(-F.col("__each")).alias("c"), F.array(F.exp(-F.col("__each"))).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("__each") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return (
        rates.withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_DRAW)).cast("int"))
        .withColumn("__each", each)
        .select(F.col("source").alias("__source"), "__draws", F.aggregate(F.sequence(F.lit(1), steps), start, add, lambda acc: acc["all"]).alias("__cdf"))
    )


def poisson_replicate(docs: DataFrame, rates: DataFrame, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each row as often as its draw says, in a globally shuffled order, plus copy and shuffle_key.

    rates: (source, rate) with a row for each source; a source without one is dropped.
    Rows with the same key draw the same number; rows with a null key draw by their
    text. Repeated rows are each replicated. Columns of docs named copy or
    shuffle_key are replaced. An empty table gives an empty table.

    The rates are broadcast if there are at most MAX_BROADCAST_SOURCES sources (which
    is checked); otherwise they are joined by (source, salt), so that a source with a
    third of the rows is dealt over SALTS tasks. The one shuffle of texts is the
    global one, by a hash of (key, copy), which is even whatever the sources are.
    """
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    cdf = _distribution(rates)
    ident = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    rows = docs.select(*kept).withColumn("__key", ident)
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(cdf), F.col(source).eqNullSafe(F.col("__source")))
    else:
        salted = cdf.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__own", F.pmod(F.hash("__key"), F.lit(SALTS))).join(salted, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__own") == F.col("__salt")))
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("__draws")),
        F.lit(0),
        lambda acc, i: acc + F.aggregate("__cdf", F.lit(0), lambda n, c: n + F.when(c <= _uniform(seed, F.col("__key"), i), 1).otherwise(0)),
    )
    one = F.aggregate("__cdf", F.lit(0), lambda n, c: n + F.when(c <= F.col("__u"), 1).otherwise(0))
    rows = rows.withColumn("__u", _uniform(seed, F.col("__key"), F.lit(1))).withColumn("__n", F.when(F.col("__draws") == 1, one).otherwise(count))
    return (
        rows.filter("__n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        .withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.col("__key"), F.col("copy").cast("string"))))
        .select(*kept, "copy", "shuffle_key")
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


ORACLE = """
WITH RECURSIVE mass AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS m FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN m > 0 THEN 1.0::DOUBLE * (SELECT sum(m) FROM mass) * pow(m, 0.7::DOUBLE) / (SELECT sum(pow(m, 0.7::DOUBLE)) FROM mass) / m ELSE 1.0::DOUBLE END AS rate FROM mass),
drawn AS (SELECT source, greatest(1, ceil(rate / 256))::INT AS draws, rate / greatest(1, ceil(rate / 256)) AS each FROM rates),
cdf(source, k, p, c) AS (
  SELECT source, 0, exp(-each), exp(-each) FROM drawn
  UNION ALL
  SELECT cdf.source, k + 1, p * d.each / (k + 1), c + p * d.each / (k + 1)
  FROM cdf JOIN drawn d ON d.source IS NOT DISTINCT FROM cdf.source WHERE k < ceil(d.each + 12 * sqrt(d.each) + 30)),
keyed AS (SELECT d.*, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key FROM documents d),
uniform AS (SELECT k.*, ('0x' || substr(md5('17:' || key || ':' || i::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM keyed k JOIN drawn r ON r.source IS NOT DISTINCT FROM k.source, unnest(range(1, r.draws + 1)) AS t(i)),
counted AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.key, count(*) AS n
  FROM uniform u JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, i::INT AS copy, md5('17:order:' || key || ':' || i::VARCHAR) AS shuffle_key
FROM counted, unnest(range(1, n + 1)) AS t(i)
"""
