"""Person names, proper names, acronyms and aliases in token frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import drop_contained

#: Particles between the parts of names.
PARTICLES = ("van", "von", "de", "der", "den", "des", "la", "le", "les", "du", "del", "della", "di", "da", "dos", "el", "al", "ter", "ten", "zu", "zur", "of", "the")
#: Additions after a name.
AFFIXES = ("jr", "sr", "ii", "iii", "iv")
LAST = r"^\p{Lu}\p{Ll}+$"
ACRONYM = r"^\p{Lu}{3,}$"


def is_last_name(c: Column) -> Column:
    """A capitalised word with a vowel."""
    return c.rlike(LAST) & F.lower(c).rlike("[aeiouyàáâäãåæèéêëìíîïòóôöõøùúûü]")


def _class(tokens: DataFrame) -> DataFrame:
    """tokens with k: n a name's word, i an initial, s a particle, a an affix, or the token itself if it is . , ; ' or a quote; null else."""
    t = F.col("tok")
    kind = F.when(F.lower("tok").isin(*PARTICLES) & t.rlike(r"^\p{Ll}"), "s").when(F.lower("tok").isin(*AFFIXES), "a").when(t.rlike(r"^\p{Lu}$"), "i").when(is_last_name(t), "n").when(t.isin(".", ",", "'", '"'), t)
    return tokens.withColumn("k", kind)


def particle_runs(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, value, upper): maximal runs of particles; upper: the first is capitalised."""
    hit = tokens.filter(F.lower("tok").isin(*PARTICLES))
    w = Window.partitionBy("doc_id").orderBy("pos")
    runs = hit.withColumn("g", F.col("pos") - F.row_number().over(w)).groupBy("doc_id", "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ").alias("value"))
    return runs.select("doc_id", "start", "end", "value", F.col("value").rlike(r"^\p{Lu}").alias("upper"))


def by_pattern(tokens: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, start, end, value): leftmost non-overlapping runs of token classes that match a regex over them, as n, i, s, a and signs stand for one token each.

    A document's classes are one string, so a pattern of optional and repeated parts is a
    single pass of the regex engine and not a chain of joins.
    """
    line = _class(tokens).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("k", F.lit("_")).alias("k"), "tok"))).alias("x"))
    code = F.array_join(F.transform("x", lambda y: F.substring(y["k"], 1, 1)), "")
    cut = line.select("doc_id", "x", code.alias("code")).withColumn("hits", F.regexp_extract_all("code", F.lit(pattern), F.lit(0))).withColumn("gaps", F.split("code", pattern, -1))
    at = F.aggregate(F.sequence(F.lit(0), F.size("hits") - 1), F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), lambda a, i: F.struct((a["p"] + F.length(F.get("gaps", i)) + F.length(F.get("hits", i))).alias("p"), F.concat(a["out"], F.array(F.struct((a["p"] + F.length(F.get("gaps", i))).alias("start"), (a["p"] + F.length(F.get("gaps", i)) + F.length(F.get("hits", i))).alias("end")))).alias("out")), lambda a: a["out"])
    spans = cut.filter(F.size("hits") > 0).select("doc_id", "x", F.explode(at).alias("s"))
    return spans.select("doc_id", "s.start", "s.end", F.array_join(F.transform(F.slice("x", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), lambda y: y["tok"]), " ").alias("value"))


#: Patterns over token classes: a last name maybe of two parts with particles; initials with points or without; a full first name.
LAST_NAME = r"n(?:s+n)?"
INITIALS = r"(?:i\.?)+"
PERSON = {
    "last initials": rf"{LAST_NAME},?{INITIALS}(?:,?a\.?)?",
    "initials last": rf"{INITIALS}s*{LAST_NAME}(?:,?a\.?)?",
    "last first": rf"{LAST_NAME},n(?:i\.?)*",
    "first last": r"n(?:i\.?)*s*n",
}


def persons(tokens: DataFrame, orders: tuple[str, ...] = tuple(PERSON)) -> DataFrame:
    """(doc_id, start, end, value, part_order): names in each part order; a name inside another one is left out."""
    out = None
    for o in orders:
        found = by_pattern(tokens, PERSON[o]).withColumn("part_order", F.lit(o))
        out = found if out is None else out.unionByName(found)
    return drop_contained(out.dropDuplicates(["doc_id", "start", "end"]))


def attributes(names: DataFrame) -> DataFrame:
    """(doc_id, part_order, initials): what all names of a document agree on; null where they differ."""
    dotted = F.when(F.col("value").rlike(r"\p{Lu} \."), "dotted").when(F.col("value").rlike(r"(^|\s)\p{Lu}(\s|$)"), "plain").otherwise("none")
    agree = lambda c, n: F.when(F.count_distinct(c) == 1, F.min(c)).alias(n)
    return names.withColumn("__i", dotted).groupBy("doc_id").agg(agree(F.col("part_order"), "part_order"), agree(F.col("__i"), "initials"))


def proper_names(tokens: DataFrame) -> DataFrame:
    """Maximal runs of name words with particles between; their parts are inside, so no closure is needed."""
    return by_pattern(tokens, r"n(?:s*n)*")


def acronyms(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("tok").rlike(ACRONYM)).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.col("tok").alias("value"))


def aliases(tokens: DataFrame) -> DataFrame:
    """Proper names in quotes of one or two signs, or double quotes."""
    return by_pattern(tokens, "(?:''n(?:s*n)*'')|(?:'n(?:s*n)*')|(?:\"n(?:s*n)*\")")


@dataclass(frozen=True)
class NameStyle:
    """What names of a collection look like; None allows everything."""

    orders: tuple[str, ...] | None = None
    affixes: bool | None = None
    particles: bool | None = None
    upper_case: bool | None = None


def in_style(found: DataFrame, style: NameStyle) -> DataFrame:
    """Those names (value, part_order) that a style allows."""
    affix = F.lower("value").rlike(r"(^|\s)(" + "|".join(AFFIXES) + r")(\s|\.|$)")
    particle = F.col("value").rlike(r"(^|\s)(" + "|".join(PARTICLES) + r")\s")
    keep = F.lit(True) if style.orders is None else F.col("part_order").isin(*style.orders)
    for wanted, has in ((style.affixes, affix), (style.particles, particle), (style.upper_case, F.col("value") == F.upper("value"))):
        keep = keep if wanted is None else keep & (has == F.lit(wanted))
    return found.filter(keep)
