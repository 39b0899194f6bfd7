"""Repair of a taxonomy: fit of parents by rank, re-attachment of orphans, promotion, split of species, redundant prefixes.

Records have id, parent (as assigned), valid (of a synonym, the accepted record), rank,
epithet, prefix (what stands before the epithet in the name), name, genus, species and
below (the epithet below genus or species). What a step looks for beneath a record, it
finds by a join on rank and epithet first and on ancestry then, never by walking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxa as tx
from .trees import paths, redirect, stored

SPECIES, GENUS = tx.NAMES.index("species") + 1, tx.NAMES.index("genus") + 1
#: Fits with which a record is a child of its parent.
HELD = ("child", "uncertain parent")


def _based_on(rank: Column, parent: Column, prefix: str, others: tuple[str, ...]) -> Column:
    """Whether the parent's rank is what the prefix stands before in the own rank, or that with one of the other prefixes."""
    base = F.substring(rank, F.lit(len(prefix) + 1), F.length(rank))
    same = F.lower(base) == F.lower(parent)
    return same | parent.isin(*(F.concat(F.lit(o), base) for o in others)) if others else same


def fitted(records: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """records with assigned (the parent, over chains of removed (id, target)), fit, and parent only where that holds.

    fit: root (kingdoms and records without a parent), missing, inverted (the parent's rank
    is lower), duplicate (it is the same), orphan (a rank that builds on another, away from
    it, that is searched for), discarded (another such), synonym parent, uncertain, uncertain
    parent, child. earmarked tells of subspecies and subgenera that are parents of their
    own rank, which may be promoted.
    """
    own = records.withColumnRenamed("parent", "__said")
    if removed is not None:
        said = own.select(F.col("__said").alias("id")).filter("id IS NOT NULL").distinct()
        own = own.join(redirect(removed, said).select(F.col("id").alias("__said"), "target"), "__said", "left").withColumn("assigned", F.col("target")).drop("target", "__said")
    else:
        own = own.withColumnRenamed("__said", "assigned")
    over = records.select(F.col("id").alias("assigned"), F.col("rank").alias("p_rank"), F.col("epithet").alias("p_epithet"), F.col("valid").alias("p_valid"))
    joined = own.join(over, "assigned", "left")
    rank, parent = F.col("rank"), F.col("p_rank")
    level, above = tx.level(rank), tx.level(parent)
    doubtful = lambda c: F.coalesce(c.contains("_incert") | (c == "'"), F.lit(False))
    searched = F.when(rank.isin("subGenus", "subFamily"), "orphan").otherwise("discarded")
    sub = F.when(_based_on(rank, parent, "sub", ()), "child").when(level > SPECIES, F.when(above < SPECIES, "orphan").otherwise("child")).when((F.lower(rank) == "subtribe") & F.lower(parent).endswith("family"), "child").otherwise(searched)
    infra = F.when(_based_on(rank, parent, "infra", ("sub",)), "child").otherwise("discarded")
    parv = F.when(_based_on(rank, parent, "parv", ("sub", "infra")), "child").otherwise("discarded")
    fit = (
        F.when((rank == "kingdom") | F.col("assigned").isNull(), "root").when(parent.isNull(), "missing").when(level < above, "inverted").when(level == above, "duplicate")
        .when(rank.startswith("sub"), sub).when(rank.startswith("infra"), infra).when(rank.startswith("parv"), parv)
        .when(F.col("p_valid").isNotNull(), "synonym parent").when(doubtful(F.col("epithet")), "uncertain").when(doubtful(F.col("p_epithet")), "uncertain parent").otherwise("child")
    )
    told = joined.withColumn("fit", fit).drop("p_rank", "p_epithet", "p_valid")
    told = told.withColumn("parent", F.when(F.col("fit").isin("root", "missing", "orphan", "discarded"), None).otherwise(F.col("assigned")))
    marks = told.filter("fit = 'duplicate' AND rank IN ('subSpecies', 'subGenus')").select(F.col("assigned").alias("id")).distinct().withColumn("earmarked", F.lit(True))
    return told.join(marks, "id", "left").withColumn("earmarked", F.coalesce("earmarked", F.lit(False)))


def _found(up: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, found): for each wanted (id, top, rank, epithet) the record of that rank and epithet nearest beneath top, or top itself; the smallest id in a tie.

    up: edges (desc, anc) of the region to search. Candidates and what is searched for meet by
    top, rank and epithet at once, and of each such place the two nearest are kept (one may be
    the record itself), so records of one name make no pairs.
    """
    place = ["top", "rank", "epithet"]
    named = records.select(F.col("id").alias("cand"), "rank", "epithet").join(wanted.select("rank", "epithet").distinct(), ["rank", "epithet"], "left_semi")
    inner = up.select(F.col("anc").alias("desc")).union(named.select("cand")).distinct()  # other records are on no line from a candidate
    lines = paths(up.join(inner, "desc", "left_semi")).withColumnRenamed("desc", "cand").withColumnRenamed("anc", "top")
    beneath = named.join(lines, "cand").select(*place, "cand", "dist").unionByName(named.withColumn("top", F.col("cand")).withColumn("dist", F.lit(0)))
    asked = beneath.join(wanted.select(*place).distinct(), place, "left_semi")
    nearest = asked.withColumn("__k", F.row_number().over(Window.partitionBy(*place).orderBy("dist", "cand"))).filter("__k <= 2").drop("__k")
    return wanted.join(nearest, place).filter("cand <> id").groupBy("id").agg(F.min_by("cand", F.struct("dist", "cand")).alias("found"))


def reattached(records: DataFrame) -> DataFrame:
    """fitted() records with orphans under the parent that their name implies.

    A subgenus wants the genus that stands before its parentheses, a subfamily the family
    of its own stem, what is below species the species in its name. It is looked for beneath
    the assigned parent: among children, their synonyms, and the other orphans of that parent.
    What is found goes under the assigned parent, as an accepted record even if it was a
    synonym. Without a find, what is below species goes under the assigned parent itself.
    """
    records = stored(records, "fitted")
    orphan = records.filter("fit = 'orphan'")
    sub_genus, sub_family = F.col("rank") == "subGenus", F.col("rank") == "subFamily"
    genus = F.regexp_extract("name", r"^([A-Z][a-z]+)\s*\(\s*[A-Z][a-z]+\s*\)", 1)
    family = F.regexp_extract("name", r"^([A-Z][a-z]+)inae(\s.*)?$", 1)
    epithet = F.when(sub_genus & (genus != ""), genus).when(sub_family & (family != ""), F.concat(family, F.lit("idae"))).when(~sub_genus & ~sub_family, F.col("species"))
    rank = F.when(sub_genus, "genus").when(sub_family, "family").otherwise("species")
    wanted = orphan.select("id", F.col("assigned").alias("top"), rank.alias("rank"), epithet.alias("epithet")).filter("epithet IS NOT NULL")
    over = F.when(F.col("valid").isNotNull(), F.col("valid")).when(F.col("fit") == "orphan", F.col("assigned")).when(F.col("fit").isin(*HELD), F.col("parent"))
    up = records.select(F.col("id").alias("desc"), over.alias("anc")).filter("anc IS NOT NULL")
    found = _found(up, records, wanted)
    tops = found.join(wanted.select("id", "top"), "id")
    raised = tops.groupBy(F.col("found").alias("id")).agg(F.min("top").alias("__top"))
    held = records.join(found, "id", "left").join(raised, "id", "left")
    below = (F.col("fit") == "orphan") & (tx.level(F.col("rank")) > SPECIES)
    parent = F.coalesce("found", F.when(below, F.col("assigned")), "__top", "parent")
    return held.withColumn("parent", parent).withColumn("valid", F.when(F.col("__top").isNull(), F.col("valid"))).withColumn("earmarked", F.col("earmarked") & F.col("found").isNull()).drop("found", "__top")


def promoted(records: DataFrame) -> DataFrame:
    """Earmarked nominotypical subspecies as species and subgenera as genera, if their parent is above that rank."""
    over = records.select(F.col("id").alias("parent"), tx.level(F.col("rank")).alias("__above"))
    up = {"subSpecies": ("species", SPECIES), "subGenus": ("genus", GENUS)}
    joined = records.join(over, "parent", "left")
    rank = F.col("rank")
    ok = F.lit(False)
    for own, (target, level) in up.items():
        ok = ok | ((F.col("rank") == own) & (F.col("__above") < level) & (F.col(target) == F.col("below")))
        rank = F.when(F.col("rank") == own, target).otherwise(rank)
    ok = F.coalesce(ok & F.col("earmarked"), F.lit(False))
    short = F.when(F.col("rank") == "subSpecies", F.when(F.col("prefix").endswith(F.concat(F.lit(" "), F.col("epithet"))), F.trim(F.regexp_replace("prefix", r"\s\S+$", ""))).otherwise(F.col("prefix")))
    new = {"prefix": F.when(ok, short).otherwise(F.col("prefix")), "below": F.when(~ok, F.col("below")), "rank": F.when(ok, rank).otherwise(F.col("rank"))}
    return joined.withColumns(new).drop("__above")


def split_species(records: DataFrame) -> DataFrame:
    """Species with two words in the epithet as subspecies, variety (var.) or form (f.) of the species of the first word, if there is one beneath their parent; that species goes directly under it."""
    two = (F.col("rank") == "species") & F.col("epithet").contains(" ") & F.col("parent").isNotNull()
    first, rest = F.substring_index("epithet", " ", 1), F.trim(F.regexp_replace("epithet", r"^\S+", ""))
    wanted = records.filter(two).select("id", F.col("parent").alias("top"), F.lit("species").alias("rank"), first.alias("epithet"))
    up = records.select(F.col("id").alias("desc"), F.coalesce("valid", "parent").alias("anc")).filter("anc IS NOT NULL")
    found = _found(up, records, wanted)
    raised = found.join(wanted.select("id", "top"), "id").groupBy(F.col("found").alias("id")).agg(F.min("top").alias("__top"))
    held = records.join(found, "id", "left").join(raised, "id", "left")
    hit = F.col("found").isNotNull()
    kind = F.when(rest.startswith("var."), "variety").when(rest.startswith("f."), "form").otherwise("subSpecies")
    bare = F.trim(F.regexp_replace(rest, r"^(subsp|var|f)\.", ""))
    out = held.withColumn("__bare", bare).withColumn("__kind", kind).withColumn("__first", first)
    return out.select(
        "id", F.coalesce("found", "__top", "parent").alias("parent"), F.when(F.col("__top").isNull(), F.col("valid")).alias("valid"), F.when(hit, F.col("__kind")).otherwise(F.col("rank")).alias("rank"),
        F.when(hit, F.col("__bare")).otherwise(F.col("epithet")).alias("epithet"), F.when(hit, F.concat_ws(" ", "prefix", "__first")).otherwise(F.col("prefix")).alias("prefix"),
        F.when(hit, F.col("__first")).otherwise(F.col("species")).alias("species"), F.when(hit, F.col("__bare")).otherwise(F.col("below")).alias("below"), *(c for c in records.columns if c not in ("id", "parent", "valid", "rank", "epithet", "prefix", "species", "below")),
    )


def rehung(records: DataFrame) -> DataFrame:
    """Records below species, or below genus, whose parent is above it, under the species that their prefix ends with, or the genus that it is, if there is one beneath their parent."""
    over = records.select(F.col("id").alias("parent"), tx.level(F.col("rank")).alias("__above"))
    joined = records.join(over, "parent", "left")
    level, above = tx.level(F.col("rank")), F.col("__above")
    low, mid = (level > SPECIES) & (above < SPECIES), (level > GENUS) & (above < GENUS)
    want = F.when(low & F.col("prefix").contains(" "), F.element_at(F.split("prefix", " "), -1)).when(~low & mid, F.col("prefix"))
    wanted = joined.select("id", F.col("parent").alias("top"), F.when(low, "species").otherwise("genus").alias("rank"), want.alias("epithet")).filter("epithet IS NOT NULL AND top IS NOT NULL")
    up = records.filter("parent IS NOT NULL AND valid IS NULL").select(F.col("id").alias("desc"), F.col("parent").alias("anc"))
    return records.join(_found(up, records, wanted), "id", "left").withColumn("parent", F.coalesce("found", "parent")).drop("found")


def plain_prefixes(records: DataFrame) -> DataFrame:
    """records with a null prefix where the tree says it: at genus and above, or where it is, or ends with, the parent's epithet, the subgenus in parentheses included or left out, or the prefix of a parent below species."""
    up = records.select("id", "parent", "rank", "epithet", "prefix")
    near = up.select(F.col("id").alias("parent"), F.col("parent").alias("__grand"), F.col("rank").alias("__r"), F.col("epithet").alias("__e"), F.col("prefix").alias("__p"))
    far = up.select(F.col("id").alias("__grand"), F.col("epithet").alias("__ge"), F.col("rank").alias("__gr"))
    j = records.join(near, "parent", "left").join(far, "__grand", "left")
    p, e = F.col("prefix"), F.col("__e")
    sub, blank = F.col("__r") == "subGenus", p.contains(" ")
    same = (p == e) | (p == F.lower(e)) | (p == F.concat(e, F.lit(" x"))) | p.endswith(F.concat(F.lit(" "), e))
    inside = sub & blank & (p.endswith(F.concat(F.lit(" ("), e, F.lit(")"))) | p.endswith(F.concat(F.lit(" ("), F.lower(e), F.lit(")"))))
    omitted = sub & ~blank & (p == F.col("__ge"))
    empty = (p == "") & (F.col("rank") == "subGenus") & (F.col("__r") == "genus")
    lower = (tx.level(F.col("__r")) > SPECIES) & ((F.col("__p") == p) | (F.col("__p").isNull() & (F.col("__gr") == "species") & p.endswith(F.concat(F.lit(" "), F.col("__ge")))))
    told = F.col("parent").isNotNull() & ((tx.level(F.col("rank")) <= GENUS) | F.coalesce(same, F.lit(False)) | F.coalesce(inside, F.lit(False)) | F.coalesce(omitted, F.lit(False)) | F.coalesce(empty, F.lit(False)) | F.coalesce(lower, F.lit(False)))
    return j.withColumn("prefix", F.when(~told, p)).select(*records.columns)
