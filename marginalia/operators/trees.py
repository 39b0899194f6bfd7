"""Trees of taxon records: closure, repair, catalogue, index and queries.

A record frame has (id, parent, rank, epithet), ids being strings or numbers; synonyms have
valid, the id of the accepted record, instead of a parent. Ancestry is computed once, as
the closure (anc, desc, dist), by doubling the lengths of paths: shuffle joins on ids, as
many as the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxa as tx
from ..sources.files import shared_path
from .ordering import numbered


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what is used more than once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def paths(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(desc, anc, dist): all paths over edges (desc, anc), or those up to a length, each pair with its shortest; no pair of a record with itself.

    Only shortest paths are kept and a round that finds no new one is the last, so cycles end too.

    Lengths double: after k rounds all paths up to 2**k are known, and a round joins those
    of exactly that length with all. Each round is a table in the shared folder, so lineage
    stays short and a lost executor costs a round.
    """
    known = stored(edges.filter("desc <> anc").select("desc", "anc").distinct().withColumn("dist", F.lit(1)), "paths")
    step = 1
    while depth is None or step < depth:
        full = known.filter(F.col("dist") == step).select("desc", F.col("anc").alias("via"))
        far = full.join(known.select(F.col("desc").alias("via"), "anc", "dist"), "via").filter("desc <> anc").select("desc", "anc", (F.col("dist") + step).alias("dist"))
        far = far.filter(F.col("dist") <= depth) if depth is not None else far
        new = stored(far.join(known.select("desc", "anc"), ["desc", "anc"], "left_anti").distinct(), "paths")
        if not new.limit(1).count():
            break
        known = stored(known.unionByName(new).groupBy("desc", "anc").agg(F.min("dist").alias("dist")), "paths")
        step *= 2
    return known


def closure(records: DataFrame) -> DataFrame:
    """(anc, desc, dist): all ancestors of each record, itself at distance 0 included. Roots have a null parent; of a cycle, all are each other's ancestors."""
    own = records.select(F.col("id").alias("anc"), F.col("id").alias("desc"), F.lit(0).alias("dist"))
    return paths(records.filter("parent IS NOT NULL").select(F.col("id").alias("desc"), F.col("parent").alias("anc"))).select("anc", "desc", "dist").unionByName(own)


def subtree_sizes(tree: DataFrame, marked: Column | None = None) -> DataFrame:
    """(id, size): how many records, or marked ones, each record's subtree has."""
    count = F.count("*") if marked is None else F.sum(marked.cast("long"))
    return tree.groupBy(F.col("anc").alias("id")).agg(count.alias("size"))


def subtree_sizes_with_synonyms(tree: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, size): how many records each record's subtree has, their synonyms (id, valid) counted too."""
    own = synonyms.groupBy(F.col("valid").alias("desc")).agg(F.count("*").alias("n"))
    return tree.join(own, "desc", "left").groupBy(F.col("anc").alias("id")).agg(F.sum(1 + F.coalesce("n", F.lit(0))).alias("size"))


def complete(tree: DataFrame, records: DataFrame, top: str = "kingdom") -> DataFrame:
    """(id, complete): whether the ranks on the way up, the own one included, have the primary rank of each group among them, and the top rank."""
    group = F.lit(None).cast("string")
    for rank, of, _ in tx.RANKS:
        group = F.when(F.col("rank") == rank, of).otherwise(group)
    ranks = records.select(F.col("id").alias("anc"), "rank", group.alias("group"))
    sets = tree.join(ranks, "anc").groupBy(F.col("desc").alias("id")).agg(F.collect_set("rank").alias("ranks"), F.collect_set("group").alias("groups"))
    return sets.select("id", (F.size(F.array_except("groups", "ranks")) == 0).alias("whole"), F.array_contains("ranks", top).alias("rooted")).select("id", (F.col("whole") & F.col("rooted")).alias("complete"))


def primary_children(tree: DataFrame, records: DataFrame) -> DataFrame:
    """(id, child): records of primary ranks, registered with every ancestor up to their nearest one of a primary rank, or up to the root without one."""
    primary = records.filter(tx.is_primary(F.col("rank"))).select("id")
    up = tree.filter("dist > 0").join(primary.withColumnRenamed("id", "desc"), "desc", "left_semi")
    nearest = up.join(primary.withColumnRenamed("id", "anc"), "anc", "left_semi").groupBy("desc").agg(F.min("dist").alias("last"))
    return up.join(nearest, "desc", "left").filter("last IS NULL OR dist <= last").select(F.col("anc").alias("id"), F.col("desc").alias("child"))


def detached(tree: DataFrame, records: DataFrame, root_rank: str) -> DataFrame:
    """(attached, n): how many records reach one of the root rank, and how many don't."""
    roots = records.filter(F.col("rank") == root_rank).select(F.col("id").alias("anc"), F.lit(True).alias("__root"))
    reach = tree.join(roots, "anc", "left").groupBy("desc").agg(F.bool_or(F.coalesce("__root", F.lit(False))).alias("attached"))
    return reach.groupBy("attached").agg(F.count("*").alias("n"))


def without(records: DataFrame, dropped: Column) -> DataFrame:
    """records without dropped ones, whose children hang on their nearest ancestor that stays; those without one become roots."""
    marked = records.withColumn("__gone", dropped)
    gone = marked.filter("__gone").select(F.col("id").alias("anc"))
    kept = marked.filter("NOT __gone").drop("__gone")
    near = closure(records).filter("dist > 0").join(gone, "anc", "left_anti").groupBy(F.col("desc").alias("id")).agg(F.min_by("anc", "dist").alias("__parent"))
    return kept.join(near, "id", "left").withColumn("parent", F.col("__parent")).drop("__parent")


def climb(records: DataFrame) -> DataFrame:
    """records whose parent is of a higher rank: each hangs on its nearest ancestor whose rank is above its own."""
    levels = records.select("id", tx.level(F.col("rank")).alias("level"))
    over = closure(records).filter("dist > 0").join(levels.select(F.col("id").alias("anc"), F.col("level").alias("la")), "anc").join(levels.select(F.col("id").alias("desc"), F.col("level").alias("ld")), "desc")
    near = over.filter("la < ld").groupBy(F.col("desc").alias("id")).agg(F.min_by("anc", "dist").alias("__parent"))
    return records.join(near, "id", "left").withColumn("parent", F.col("__parent")).drop("__parent")


def lineage_ranks(tree: DataFrame, records: DataFrame) -> DataFrame:
    """(id, ranks): the set of ranks on the way up, the own one included."""
    ranks = records.select(F.col("id").alias("anc"), "rank")
    return tree.join(ranks, "anc").groupBy(F.col("desc").alias("id")).agg(F.array_sort(F.collect_set("rank")).alias("ranks"))


def higher_taxonomy(tree: DataFrame, records: DataFrame, primary_only: bool = True) -> DataFrame:
    """(id, higher): epithet of each higher rank."""
    names = records.select(F.col("id").alias("anc"), "rank", "epithet").filter(tx.is_primary(F.col("rank")) if primary_only else F.lit(True))
    return tree.filter("dist > 0").join(names, "anc").groupBy(F.col("desc").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rank", "epithet")))).alias("higher"))


def primary_parent(tree: DataFrame, records: DataFrame) -> DataFrame:
    """(id, primary_parent): the nearest ancestor of a primary rank."""
    primary = records.filter(tx.is_primary(F.col("rank"))).select(F.col("id").alias("anc"))
    return tree.filter("dist > 0").join(primary, "anc", "left_semi").groupBy(F.col("desc").alias("id")).agg(F.min_by("anc", "dist").alias("primary_parent"))


def family(records: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(id, children, synonyms): sorted ids; null where there are none."""
    children = records.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))
    same = synonyms.groupBy(F.col("valid").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("synonyms"))
    return records.select("id").join(children, "id", "left").join(same, "id", "left")


def dense_ids(tree: DataFrame, records: DataFrame, cluster: Column) -> DataFrame:
    """(id, number): numbers without gaps in each cluster, parents before children, siblings by epithet.

    Sorted by ranges over all tasks, so a cluster of nearly all records is no window of one task.
    """
    names = records.select(F.col("id").alias("anc"), F.coalesce("epithet", F.lit("")).alias("e"))
    path = tree.join(names, "anc").groupBy(F.col("desc").alias("id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "e", F.col("anc").cast("string").alias("a")))).alias("p"))
    keyed = records.withColumn("cluster", cluster).join(path, "id").select("id", "cluster", F.size("p").alias("level"), F.transform("p", lambda x: F.struct(x["e"], x["a"])).alias("path"))
    return numbered(keyed, ["level", "path", "id"], "cluster").select("id", "cluster", F.col("number").cast("int").alias("number"))


def descendants(records: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, dist): what is beneath the roots (id), found level by level; each level is a table in the shared folder, and a record once found isn't followed again."""
    spark = records.sparkSession
    children = records.filter("parent IS NOT NULL").select("id", "parent")
    level, out, dist = roots.select(F.col("id").alias("root"), "id"), None, 0
    while True:
        dist += 1
        found = level.select("root", F.col("id").alias("parent")).join(children, "parent").select("root", "id").filter("id <> root").distinct()
        found = found.join(out.select("root", "id"), ["root", "id"], "left_anti") if out is not None else found
        folder = shared_path(spark, "level")
        found.withColumn("dist", F.lit(dist)).write.parquet(folder)
        level = spark.read.schema("root string, id string, dist int" if dict(roots.dtypes)["id"] == "string" else "root long, id long, dist int").parquet(folder)
        if not level.limit(1).count():
            return out if out is not None else level
        out = level if out is None else out.unionByName(level)


def assign_cluster(tree: DataFrame, records: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, cluster): of clusters (anc, cluster), that of the nearest ancestor that has one; else "other"."""
    near = tree.join(clusters, "anc").groupBy(F.col("desc").alias("id")).agg(F.min_by("cluster", "dist").alias("cluster"))
    return records.select("id").join(near, "id", "left").select("id", F.coalesce("cluster", F.lit("other")).alias("cluster"))


def _upper(records: DataFrame, last: str) -> DataFrame:
    """(id, rank, epithet): the records of primary ranks down to last; few, as there are few such names."""
    return records.filter(tx.is_primary(F.col("rank")) & (tx.level(F.col("rank")) <= tx.NAMES.index(last) + 1)).select("id", "rank", "epithet")


def kingdom_paths(tree: DataFrame, records: DataFrame, last: str = "family") -> DataFrame:
    """(id, path) of the records of primary ranks down to last: their primary ancestors' epithets from the top, "<rank>" for a rank left out between, then Zzz, joined by dots."""
    upper = _upper(records, last)
    ranks = [n for n, g, _ in tx.RANKS if n == g][: [n for n, g, _ in tx.RANKS if n == g].index(last) + 1]
    lines = tree.join(upper.select(F.col("id").alias("anc"), "rank", "epithet"), "anc").join(upper.select(F.col("id").alias("desc"), F.col("rank").alias("own")), "desc")
    of = lines.groupBy(F.col("desc").alias("id"), "own").agg(*(F.min_by(F.when(F.col("rank") == n, F.col("epithet")), F.when(F.col("rank") == n, F.col("dist"))).alias(f"at_{n}") for n in ranks))
    seen, parts = F.lit(False), []
    for k, n in enumerate(ranks):
        within = F.lit(k) < F.array_position(F.array(*map(F.lit, ranks)), F.col("own"))
        parts.append(F.when(within, F.coalesce(F.col(f"at_{n}"), F.when(seen, f"<{n}>"))))
        seen = seen | F.col(f"at_{n}").isNotNull()
    return of.select("id", F.concat_ws(".", *parts, F.lit("Zzz")).alias("path"))


def assign_cluster_by_path(tree: DataFrame, records: DataFrame, clusters: DataFrame, last: str = "family") -> DataFrame:
    """(id, cluster): of configured clusters (path, cluster), that of the longest path on the way down to the record; else "other"."""
    return assign_cluster(tree, records, kingdom_paths(tree, records, last).join(clusters, "path").select(F.col("id").alias("anc"), "cluster"))


def size_report(tree: DataFrame, records: DataFrame, least: int = 100_000, last: str = "family") -> DataFrame:
    """(id, path, size): where to cut a catalogue, from kingdoms down. A record of at least so many is followed by its primary children, unless one of them is smaller than that but more than half of it."""
    upper = _upper(records, last)
    sized = upper.join(subtree_sizes(tree), "id").select("id", "rank", "size")
    parents = primary_parent(tree, records).join(sized, "id").select("primary_parent", F.col("size").alias("child"))
    heavy = parents.join(sized.select(F.col("id").alias("primary_parent"), "size"), "primary_parent").filter((F.col("child") < least) & (F.col("size") < 2 * F.col("child"))).select(F.col("primary_parent").alias("id")).distinct()
    opened = sized.filter(F.col("size") >= least).join(heavy, "id", "left_anti").select(F.col("id").alias("anc"), F.lit(True).alias("open"))
    above = tree.filter("dist > 0").join(upper.select(F.col("id").alias("anc"), "rank"), "anc").join(upper.select(F.col("id").alias("desc")), "desc").join(opened, "anc", "left")
    shut = above.groupBy(F.col("desc").alias("id")).agg(F.count(F.when(F.col("open").isNull(), 1)).alias("shut"), F.max((F.col("rank") == "kingdom").cast("int")).alias("rooted"))
    kept = sized.join(shut, "id", "left").filter((F.col("rank") == "kingdom") | ((F.col("shut") == 0) & (F.col("rooted") == 1)))
    return kept.join(kingdom_paths(tree, records, last), "id").select("id", "path", "size")


def redirect(removed: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, target): each id's replacement, followed over chains of removed (id, target), self-loops ignored; null if a chain ends in nothing."""
    links = removed.filter("target IS NULL OR target <> id").select("id", F.col("target").alias("parent"))
    ends = closure(links).join(links.select(F.col("id").alias("anc"), F.lit(True).alias("__gone")), "anc", "left")
    last = ends.groupBy(F.col("desc").alias("id")).agg(F.max_by(F.when(F.col("__gone").isNull(), F.col("anc")), "dist").alias("target"), F.lit(True).alias("__known"))
    return ids.join(last, "id", "left").select("id", F.when(F.col("__known").isNull(), F.col("id")).otherwise(F.col("target")).alias("target"))


def postings(records: DataFrame, text: str = "epithet") -> DataFrame:
    """(term, kind, cap, id): the index. The lower-cased epithet without other characters than letters, digits and hyphens is kind E; its shorter words' prefixes of three characters or more are kind P."""
    term = F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9-]", "")
    whole = records.select(term.alias("term"), F.lit("E").alias("kind"), F.col(text).rlike("^[A-Z]").alias("cap"), "id")
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9-]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin("subsp", "var", "sect", "ser"))
    part = records.select(F.explode(words).alias("term"), F.lit("P").alias("kind"), F.col(text).rlike("^[A-Z]").alias("cap"), "id")
    return whole.unionByName(part.filter(F.col("term") != "")).filter("term <> ''")


def postings_with_prefixes(records: DataFrame) -> DataFrame:
    """(term, kind, cap, id): as postings(), of records (id, valid, epithet, prefix); but words of kind P are those of synonyms' prefixes only."""
    whole = postings(records, "epithet").filter("kind = 'E'")
    return whole.unionByName(postings(records.filter("valid IS NOT NULL AND prefix IS NOT NULL"), "prefix").filter("kind = 'P'"))


def prefix_counts(terms: DataFrame, least: int, longest: int = 6) -> DataFrame:
    """(prefix, n): prefixes of terms with their counts; one is extended only while it has at least so many terms."""
    out, live = None, terms
    for k in range(1, longest + 1):
        counts = live.groupBy(F.substring("term", 1, k).alias("prefix")).agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
        live = live.join(counts.filter((F.col("n") >= least) & (F.length("prefix") == k)).select("prefix"), F.substring("term", 1, k) == F.col("prefix"), "left_semi")
    return out


def tile_ranges(tiles: DataFrame) -> DataFrame:
    """tiles (tile, lo) with hi, the next one's lo, and whether it overlaps the one before by (lo, last)."""
    w = Window.orderBy("lo")  # the catalogue of tiles is a small dimension
    return tiles.withColumn("hi", F.lead("lo").over(w)).withColumn("overlaps", F.coalesce(F.lag("last").over(w) >= F.col("lo"), F.lit(False)))


def find(index: DataFrame, records: DataFrame, query: str, from_rank: str, to_rank: str, prefix: bool, case_sensitive: bool = False, synonyms: bool = True) -> DataFrame:
    """Records whose epithet is, or begins with, the query, with a rank in the window; a capital in the query asks for capitalised epithets.

    case_sensitive asks for the same letters in the epithet itself; without synonyms, records
    with a valid one are left out.
    """
    if case_sensitive:
        records = records.filter(tx.matches(F.col("epithet"), F.lit(query), prefix, True))
    if not synonyms and "valid" in records.columns:
        records = records.filter("valid IS NULL")
    q = query.lower()
    hit = index.filter((F.col("kind") == "E") & (F.col("cap") == F.lit(query[:1].isupper())) & (F.col("term").startswith(q) if prefix else F.col("term") == q)).select("id").distinct()
    inside = tx.level(F.col("rank")).between(tx.NAMES.index(from_rank) + 1, tx.NAMES.index(to_rank) + 1)
    return records.filter(inside).join(hit, "id", "left_semi")


def prefix_matches(tree: DataFrame, records: DataFrame, words: list[str], lenient: bool) -> DataFrame:
    """(id): records among whose higher epithets the words occur in order; strict: as direct ancestors without others between; lenient: others may stand between."""
    names = records.select(F.col("id").alias("anc"), "epithet")
    line = tree.filter("dist > 0").join(names, "anc").groupBy(F.col("desc").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "epithet"))), lambda x: F.lower(x["epithet"])).alias("line"))
    wanted = [w.lower() for w in words]
    got = F.aggregate("line", F.lit(0), lambda k, e: F.when((k < len(wanted)) & (F.try_element_at(F.array(*map(F.lit, wanted)), k + 1) == e), k + 1).otherwise(k))
    ok = got == len(wanted) if lenient else F.slice("line", -len(wanted), len(wanted)) == F.array(*map(F.lit, wanted))
    return line.filter((F.size("line") >= len(wanted)) & ok).select("id")


MODES = ("strict", "intermediate", "lenient")


def epithet_prefix_matches(tree: DataFrame, records: DataFrame, words: list[str], mode: str, prefix: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(id): records whose ancestors bear the words, the last one first on the way up.

    An ancestor that doesn't bear the next word ends the search in strict mode, in
    intermediate mode if its rank is primary, and in any mode from genus on; otherwise it is
    passed over. Below species, one of the words has to be the species', unless lenient.
    """
    if mode not in MODES:
        raise ValueError(mode)
    genus, species = tx.NAMES.index("genus") + 1, tx.NAMES.index("species") + 1
    names = records.select(F.col("id").alias("anc"), F.coalesce("epithet", F.lit("")).alias("e"), tx.level(F.col("rank")).alias("level"), tx.is_primary(F.col("rank")).alias("primary"))
    line = tree.filter("dist > 0").join(names, "anc").groupBy(F.col("desc").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dist", "e", "level", "primary"))).alias("line"))
    wanted = F.array(*map(F.lit, reversed(words)))

    def step(s, a):  # noqa: ANN001, ANN202
        hit = tx.matches(a["e"], F.try_element_at(wanted, s["k"] + 1), prefix, case_sensitive)
        stop = F.lit(True) if mode == "strict" else (a["level"] <= genus) | (a["primary"] if mode == "intermediate" else F.lit(False))
        going = s["ok"] & (s["k"] < len(words))
        return F.struct(F.when(going & hit, s["k"] + 1).otherwise(s["k"]).alias("k"), (s["ok"] & (~going | hit | ~stop)).alias("ok"), (s["species"] | (going & hit & (a["level"] == species))).alias("species"))

    end = F.aggregate("line", F.struct(F.lit(0).alias("k"), F.lit(True).alias("ok"), F.lit(False).alias("species")), step)
    told = records.select("id", tx.level(F.col("rank")).alias("own")).join(line, "id").select("id", "own", end.alias("s"))
    need = F.lit(True) if mode == "lenient" else (F.col("own") <= species) | F.col("s.species")
    return told.filter(F.col("s.ok") & (F.col("s.k") == len(words)) & need).select("id")


def problems(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(problem, n): how many rows have each problem."""
    return rows.select(F.explode(F.filter(F.array(*(F.when(c, n) for n, c in checks)), lambda x: x.isNotNull())).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
