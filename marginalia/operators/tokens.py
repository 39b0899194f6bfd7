"""Tokens and typed spans: the primitives that all text analysers share.

A token frame has (key, pos, tok); a span frame has (key, start, end, type, value), with
half-open token positions. Both stay partitioned by the document's key.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of letters, runs of digits, and single other characters.
TOKEN = r"[\p{L}\p{M}]+|[0-9]+|[^\s\p{L}\p{M}0-9]"
#: Accented letters and their base letters, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, tok) of each text; null texts have none."""
    return df.select(key, F.posexplode(token_array(F.col(text))).alias("pos", "tok"))


def window_spans(df: DataFrame, pattern: str, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, value): every window of exactly size tokens whose text, joined by blanks, matches the pattern. Overlapping ones all count."""
    toks = df.select(key, token_array(F.col(text)).alias("t")).filter(F.size("t") >= size)
    at = F.transform(F.sequence(F.lit(0), F.size("t") - size), lambda i: F.struct(i.cast("long").alias("start"), F.array_join(F.slice("t", i + 1, F.lit(size)), " ").alias("value")))
    found = toks.select(key, F.explode(F.filter(at, lambda x: x["value"].rlike(pattern))).alias("w"))
    return found.select(key, "w.start", (F.col("w.start") + size).alias("end"), "w.value")


def dictionary_spans(df: DataFrame, dictionary: DataFrame, size: int, key: str = "doc_id", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """(key, start, end, value): windows of size tokens whose joined text is in dictionary (term)."""
    fold = (lambda c: c) if case_sensitive else F.lower
    grams = window_spans(df, "", size, key, text).withColumn("term", fold(F.col("value")))
    return grams.join(dictionary.select(fold(F.col("term")).alias("term")).distinct(), "term", "left_semi").drop("term")


def windows_up_to(df: DataFrame, pattern: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, value): every window of 1 to most tokens whose text, joined by blanks, matches the pattern."""
    toks = df.select(key, token_array(F.col(text)).alias("t")).filter(F.size("t") > 0)
    return _windows(toks, list(range(1, most + 1)), key, lambda value: value.rlike(pattern))


def _windows(toks: DataFrame, sizes: list[int], key: str, wanted) -> DataFrame:  # noqa: ANN001
    one = lambda n: F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(i.cast("long").alias("start"), (i + n).cast("long").alias("end"), F.array_join(F.slice("t", i + 1, F.lit(n)), " ").alias("value"))))
    every = F.flatten(F.filter(F.array(*(one(n) for n in sizes)), lambda x: x.isNotNull()))
    return toks.select(key, F.explode(F.filter(every, lambda x: wanted(x["value"]))).alias("w")).select(key, "w.start", "w.end", "w.value")


def dictionary_matches(df: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", case_sensitive: bool = False) -> DataFrame:
    """(key, start, end, value): windows whose joined text is an entry of dictionary (term), entries being of any number of tokens.

    Windows are of the numbers of tokens that entries have, a few; blanks and punctuation of
    an entry are read as those of a text.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    terms = dictionary.select(token_array(F.col("term")).alias("t")).filter(F.size("t") > 0)
    sizes = sorted(r.n for r in terms.select(F.size("t").alias("n")).distinct().collect())
    toks = df.select(key, token_array(F.col(text)).alias("t")).filter(F.size("t") > 0)
    if not sizes:
        return _windows(toks, [1], key, lambda v: F.lit(False))
    grams = _windows(toks, sizes, key, lambda v: F.lit(True)).withColumn("term", fold(F.col("value")))
    return grams.join(terms.select(fold(F.array_join("t", " ")).alias("term")).distinct(), "term", "left_semi").drop("term")


def adjacent(left: DataFrame, right: DataFrame, key: str = "doc_id", gap: int = 0) -> DataFrame:
    """Pairs of spans of which right starts exactly gap tokens after left ends; columns of left, and right's with suffix _r."""
    other = right.select(F.col(key), (F.col("start") - gap).alias("end"), *(F.col(c).alias(f"{c}_r") for c in right.columns if c != key))
    return left.join(other, [key, "end"])


def drop_contained(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that aren't inside another one; equal spans are one. A running maximum of ends replaces the containment join."""
    before = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    once = spans.dropDuplicates([key, "start", "end"])
    return once.withColumn("__reach", F.max("end").over(before)).filter("__reach IS NULL OR end > __reach").drop("__reach")


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two half-open ranges share a position."""
    return (start_a < end_b) & (start_b < end_a)


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def fold_marks(text: Column) -> Column:
    """Letters without their diacritical marks, in any script that decomposes them; Spark has no Unicode normalisation of its own."""

    def fold(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    def run(column: pd.Series) -> pd.Series:
        return column.map(fold)

    return F.pandas_udf(run, "string")(text)


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one starts in each row in which breaks holds. One window over keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


_ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999, else null."""
    out, rest = F.lit(""), n
    for value, sign in _ROMAN:
        out, rest = F.concat(out, F.repeat(F.lit(sign), (rest / value).cast("int"))), F.pmod(rest, F.lit(value))
    return F.when(n.between(1, 3999), out)


def is_roman(text: Column) -> Column:
    return F.upper(text).rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")


def roman_value(text: Column) -> Column:
    """Value of a Roman numeral in any case; null if it isn't one. A sign before a larger one counts negatively."""
    values = F.transform(F.split(F.upper(text), ""), lambda c: F.coalesce(*(F.when(c == s, v) for v, s in _ROMAN if len(s) == 1), F.lit(0)))
    total = F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + v - F.when(a["last"] < v, 2 * a["last"]).otherwise(0)).alias("sum"), v.alias("last")), lambda a: a["sum"])
    return F.when(is_roman(text), total)
