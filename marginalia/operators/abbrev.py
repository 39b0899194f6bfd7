"""Abbreviations: numbering runs, ranges and their resolution.

Paragraph frames have (doc_id, par, text); reference frames (doc_id, prefix, numbering).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import is_roman, roman, roman_value


def number_runs(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, first, last, script, sign): runs of two or more paragraphs in a row that are numbered consecutively in one script with one sign."""
    p = r"^\(?([0-9]+|[IVXLCDMivxlcdm]+)([.):])\s"
    label, sign = F.regexp_extract("text", p, 1), F.regexp_extract("text", p, 2)
    n = F.when(label.rlike("^[0-9]+$"), label.cast("int")).otherwise(roman_value(label))
    hit = paragraphs.select("doc_id", "par", n.alias("n"), F.when(label.rlike("^[0-9]+$"), "arabic").otherwise("roman").alias("script"), sign.alias("sign")).filter("n IS NOT NULL")
    w = Window.partitionBy("doc_id", "script", "sign").orderBy("par")
    g = hit.withColumn("g", F.col("par") - F.row_number().over(w)).withColumn("h", F.col("n") - F.col("par"))
    return g.groupBy("doc_id", "script", "sign", "g", "h").agg(F.min("par").alias("first"), F.max("par").alias("last"), F.count("*").alias("k")).filter("k > 1").select("doc_id", "first", "last", "script", "sign")


def strict_and_relaxed(paragraphs: DataFrame, strict: str, relaxed: str) -> DataFrame:
    """(doc_id, par, value): matches of the strict pattern; of the relaxed one only where a paragraph has no strict match and both its neighbours have."""
    w = Window.partitionBy("doc_id").orderBy("par")
    s = paragraphs.withColumn("a", F.regexp_extract_all("text", F.lit(strict), F.lit(1))).withColumn("n", F.size("a"))
    s = s.withColumn("both", (F.coalesce(F.lag("n").over(w), F.lit(0)) > 0) & (F.coalesce(F.lead("n").over(w), F.lit(0)) > 0))
    values = F.when(F.col("n") > 0, F.col("a")).when(F.col("both"), F.regexp_extract_all("text", F.lit(relaxed), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return s.select("doc_id", "par", F.explode(values).alias("value"))


def prefix_candidates(known: DataFrame) -> DataFrame:
    """(doc_id, value): proper prefixes of a document's known abbreviations."""
    return known.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("value") - 1)), lambda k: F.substring(F.col("value"), F.lit(1), k))).alias("p"), "value").filter(F.col("p") != F.col("value")).select("doc_id", F.col("p").alias("value")).distinct()


def parents(known: DataFrame) -> DataFrame:
    """(doc_id, value, parent, level): the longest proper prefix that is an abbreviation too; level counts all that are, plus one."""
    k = known.select("doc_id", "value").distinct()
    p = k.select("doc_id", "value", F.explode(F.transform(F.sequence(F.lit(1), F.length("value")), lambda i: F.substring(F.col("value"), F.lit(1), i))).alias("p"))
    hit = p.join(k.select("doc_id", F.col("value").alias("p")), ["doc_id", "p"])
    return hit.groupBy("doc_id", "value").agg(F.max_by(F.when(F.col("p") != F.col("value"), F.col("p")), F.when(F.col("p") != F.col("value"), F.length("p"))).alias("parent"), F.count("*").cast("int").alias("level"))


def inherit_text(entries: DataFrame) -> DataFrame:
    """entries (doc_id, ord, level, text) with implied: own text after the implied text of the nearest earlier entry of a lower level. A fold over each document's entries."""
    whole = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "level", "text"))).alias("e"))

    def step(a: Column, x: Column) -> Column:
        above = F.filter(a, lambda y: y["level"] < x["level"])
        before = F.try_element_at(above, F.lit(-1))["implied"]
        return F.concat(a, F.array(F.struct(x["ord"].alias("ord"), x["level"].alias("level"), F.concat_ws(" ", before, x["text"]).alias("implied"))))

    kind = f"array<struct<ord:{entries.schema['ord'].dataType.simpleString()},level:{entries.schema['level'].dataType.simpleString()},implied:string>>"
    return whole.select("doc_id", F.explode(F.aggregate("e", F.array().cast(kind), step)).alias("x")).select("doc_id", "x.*")


def schemes(candidates: DataFrame) -> DataFrame:
    """(doc_id, scheme, score) of numbering tokens (doc_id, tok): one for each Arabic, Roman or letter; schemes with a fifth of the best score or less are dropped."""
    t = F.col("tok")
    scheme = F.when(t.rlike("^[0-9]+$"), "arabic").when(is_roman(t), "roman").when(t.rlike("^[A-Za-z]$"), "letter")
    s = candidates.withColumn("scheme", scheme).filter("scheme IS NOT NULL").groupBy("doc_id", "scheme").agg(F.count("*").alias("score"))
    return s.withColumn("m", F.max("score").over(Window.partitionBy("doc_id"))).filter(F.col("score") * 5 > F.col("m")).drop("m")


def parts(numbering: Column) -> Column:
    """A numbering like "1-3, 7" as an array of struct(lo, hi); falling and malformed parts are left out."""
    one = lambda p: F.struct(F.regexp_extract(p, r"^\s*([0-9]{1,6})", 1).try_cast("int").alias("lo"), F.regexp_extract(p, r"([0-9]{1,6})\s*$", 1).try_cast("int").alias("hi"))
    return F.filter(F.transform(F.split(F.regexp_replace(numbering, "[–—]", "-"), ",|&| and "), one), lambda x: x["lo"].isNotNull() & x["hi"].isNotNull() & (x["lo"] <= x["hi"]))


def combine(numbering: Column) -> Column:
    """Rising parts of a numbering merged where they touch, as text."""
    step = lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["hi"] + 1 >= x["lo"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["lo"].alias("lo"), F.greatest(F.try_element_at(a, F.lit(-1))["hi"], x["hi"]).alias("hi"))))).otherwise(F.concat(a, F.array(x)))
    merged = F.aggregate(F.array_sort(parts(numbering)), F.array().cast("array<struct<lo:int,hi:int>>"), step)
    return F.array_join(F.transform(merged, lambda x: F.when(x["lo"] == x["hi"], x["lo"].cast("string")).otherwise(F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string")))), ",")


def score(numbering: Column) -> Column:
    """1 for a single number, 10 for a range, 20 for an enumeration."""
    p = parts(numbering)
    return F.when(F.size(p) > 1, 20).when(F.size(p) == 0, 0).when(p[0]["lo"] < p[0]["hi"], 10).otherwise(1)


def with_ranges(references: DataFrame) -> DataFrame:
    """References whose prefix has a real range or enumeration somewhere in the document."""
    real = references.filter(score(F.col("numbering")) >= 10).select("doc_id", "prefix").distinct()
    return references.join(real, ["doc_id", "prefix"], "left_semi")


def expand(references: DataFrame) -> DataFrame:
    """(doc_id, prefix, n): every number of every reference, once."""
    numbers = F.flatten(F.transform(parts(F.col("numbering")), lambda x: F.sequence(x["lo"], x["hi"])))
    return references.select("doc_id", "prefix", F.explode(numbers).alias("n")).distinct()


def format_number(n: Column, scheme: Column) -> Column:
    """A number by its scheme: arabic, roman or ROMAN, letter; null where it has none."""
    return F.when(scheme == "arabic", n.cast("string")).when(scheme == "ROMAN", roman(n)).when(scheme == "roman", F.lower(roman(n))).when((scheme == "letter") & n.between(1, 26), F.char(n + 96))


def parse_number(tok: Column, scheme: Column) -> Column:
    """The reverse; -1 where it fails."""
    return F.coalesce(F.when(scheme == "arabic", tok.try_cast("int")).when(F.lower(scheme) == "roman", roman_value(tok)).when((scheme == "letter") & tok.rlike("^[a-z]$"), F.ascii(tok) - 96), F.lit(-1))


def resolve(references: DataFrame, entries: DataFrame) -> DataFrame:
    """references (doc_id, key) with value of entries (doc_id, key, value): by the key as it is, else without case and points."""
    fold = lambda c: F.lower(F.regexp_replace(c, r"\.", ""))
    exact = entries.groupBy("doc_id", "key").agg(F.min("value").alias("__exact"))
    loose = entries.groupBy("doc_id", fold(F.col("key")).alias("__k")).agg(F.min("value").alias("__loose"))
    out = references.join(exact, ["doc_id", "key"], "left").withColumn("__k", fold(F.col("key"))).join(loose, ["doc_id", "__k"], "left")
    return out.withColumn("value", F.coalesce("__exact", "__loose")).drop("__k", "__exact", "__loose")


def tag_references(tokens: DataFrame, entries: DataFrame, defining: DataFrame) -> DataFrame:
    """(doc_id, pos, tok): tokens that are keys of entries but for points, outside of defining documents' paragraphs (doc_id, pos)."""
    keys = entries.select("doc_id", F.regexp_replace("key", r"\.", "").alias("k")).distinct()
    hit = tokens.withColumn("k", F.regexp_replace("tok", r"\.", "")).join(keys, ["doc_id", "k"], "left_semi").drop("k")
    return hit.join(defining, ["doc_id", "pos"], "left_anti")


def augment(attributes: DataFrame) -> DataFrame:
    """(doc_id, attrs) of details (doc_id, ord, type, attr, value): type--attr, or type--k--attr where a document has more than one value of them."""
    w = Window.partitionBy("doc_id", "type", "attr")
    k, n = F.row_number().over(w.orderBy("ord")), F.count("*").over(w)
    named = attributes.withColumn("k", k).withColumn("n", n).withColumn("name", F.when(F.col("n") > 1, F.concat_ws("--", "type", F.col("k").cast("string"), "attr")).otherwise(F.concat_ws("--", "type", "attr")))
    return named.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attrs"))


def implied(attrs: DataFrame) -> DataFrame:
    """(doc_id, type, k, attr, value) read back from augmented attributes; k is 1 where there is one."""
    e = attrs.select("doc_id", F.explode("attrs").alias("name", "value")).withColumn("p", F.split("name", "--"))
    return e.select("doc_id", F.col("p")[0].alias("type"), F.when(F.size("p") == 3, F.col("p")[1].cast("int")).otherwise(1).alias("k"), F.element_at("p", -1).alias("attr"), "value")
