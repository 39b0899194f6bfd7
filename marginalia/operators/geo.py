"""Countries and regions: names to codes and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import fuzzy_key
from .tokens import fold_accents


def fuzzy_keys(names: DataFrame) -> DataFrame:
    """(fuzzy, name): keys that keep three quarters of the letters at least and aren't a name themselves; the first name of a key."""
    letters = F.length(F.regexp_replace(F.lower(fold_accents(F.col("name"))), "[^a-z]", ""))
    keyed = names.select("name", fuzzy_key(F.col("name")).alias("fuzzy")).filter(F.length("fuzzy") * 4 >= letters * 3)
    exact = names.select(F.lower("name").alias("fuzzy")).distinct()
    return keyed.join(exact, "fuzzy", "left_anti").groupBy("fuzzy").agg(F.min("name").alias("name"))


def country_names(df: DataFrame, text: str, names: DataFrame, fuzzy: bool = True) -> DataFrame:
    """df with country: the name that equals the text but for case, or but for accents, or by its fuzzy key; else the text itself. Which side is broadcast, if any, is left to AQE, which knows their sizes."""
    exact = names.select(F.lower("name").alias("__k"), F.col("name").alias("__exact")).dropDuplicates(["__k"])
    plain = names.select(F.lower(fold_accents(F.col("name"))).alias("__k"), F.col("name").alias("__plain")).dropDuplicates(["__k"])
    out = df.join(exact, F.lower(text) == F.col("__k"), "left").drop("__k")
    out = out.join(plain, F.lower(fold_accents(F.col(text))) == F.col("__k"), "left").drop("__k")
    if fuzzy:
        out = out.join(fuzzy_keys(names), fuzzy_key(F.col(text)) == F.col("fuzzy"), "left").withColumnRenamed("name", "__fuzzy").drop("fuzzy")
    return out.withColumn("country", F.coalesce("__exact", "__plain", *(["__fuzzy"] if fuzzy else []), text)).drop("__exact", "__plain", "__fuzzy")


def is_country(text: Column, name: Column) -> Column:
    """Equality but for case; the text must have a capital."""
    return (F.lower(text) == F.lower(name)) & text.rlike("[A-Z]")


#: Languages that every filter admits.
ALWAYS = ("English", "ISO", "initialism", "official")


def regions_in(regions: DataFrame, languages: list[str]) -> DataFrame:
    """Region names (iso3, region, name, languages) in the wanted languages, or in those always admitted."""
    return regions.filter(F.arrays_overlap("languages", F.array(*map(F.lit, [*languages, *ALWAYS]))))


def region_handler(iso3: Column, country: Column) -> Column:
    """A region table's code: the country's ISO code, else NI- and its capitals."""
    return F.coalesce(F.when(iso3 != "", iso3), F.concat(F.lit("NI-"), F.regexp_replace(country, "[^A-Z]", "")))
