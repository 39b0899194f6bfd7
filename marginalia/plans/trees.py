"""Queries on trees: the tree of regions, nations, customers and orders, and its repair, index and catalogue."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import taxa as tx
from ..operators import repair as rp
from ..operators import trees as tr
from ..session import table

C = F.col
#: The tree in SQL that both engines read. Ids are strings; every seventh customer is a placeholder, every eleventh order hangs on a nation.
TREE = """SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR(20)) AS parent, 'kingdom' AS rank, r_name AS epithet FROM {region}
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'family', 'Nation' || n_nationkey FROM {nation}
UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 'n' || c_nationkey END, CASE WHEN c_custkey % 7 = 0 THEN 'tribe' ELSE 'genus' END, CASE WHEN c_custkey % 7 = 0 THEN 'incert' ELSE 'Genus' || (c_custkey % 400) END FROM {customer}
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'subFamily' ELSE 'species' END, lower(substr(o_orderpriority, 3)) || ' ' || (o_orderkey % 60) FROM {orders}"""
T = "t AS (" + TREE.format(region="region", nation="nation", customer="customer", orders="orders") + ")"
CL = T + ", c(descendant, anc, dist) AS (SELECT id, id, 0 FROM t UNION ALL SELECT c.descendant, t.parent, dist + 1 FROM c JOIN t ON t.id = c.anc WHERE t.parent IS NOT NULL)"


def tree(s, d):
    return s.sql(TREE, **{n: table(s, d, n) for n in ("region", "nation", "customer", "orders")})


def close(s, d):
    return tr.closure(tree(s, d))


LEVEL = "list_position(['" + "', '".join(tx.NAMES) + "'], rank)"
PRIMARY = "('" + "', '".join(n for n, g, _ in tx.RANKS if n == g) + "')"


def synonyms(s, d):
    return table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.concat(F.lit("o"), C("p_partkey") % 700).alias("valid"), C("p_name").alias("epithet"))


def redirects(s, d):
    o = table(s, d, "orders").filter("o_orderkey % 5 = 0")
    return o.select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 35 > 0, F.floor(C("o_orderkey") / 10) * 5).alias("target"))


RED = """g AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 35 > 0 THEN floor(o_orderkey / 10)::BIGINT * 5 END AS target FROM orders WHERE o_orderkey % 5 = 0), l AS (SELECT * FROM g WHERE target IS NULL OR target <> id),
w(id, pt, k) AS (SELECT id, id, 0 FROM l UNION ALL SELECT w.id, l.target, k + 1 FROM w JOIN l ON l.id = w.pt WHERE l.target IS NOT NULL AND k < 64),
e AS (SELECT id, arg_max(pt, k) AS pt FROM w GROUP BY 1)"""

IDX = "x AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9-]', '', 'g') AS term, 'E' AS kind, false AS cap, p_partkey AS id FROM part UNION ALL SELECT term, 'P', false, id FROM (SELECT unnest(str_split(p_name, ' ')) AS term, p_partkey AS id FROM part) WHERE length(term) >= 3)"


def index(s, d):
    return tr.postings(table(s, d, "part").select(C("p_partkey").alias("id"), "p_name"), "p_name")


def words(s, d):
    return table(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()


def sql_prefixes(least: int, longest: int) -> str:
    out, live = [], "w"
    ctes = ["w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"]
    for k in range(1, longest + 1):
        ctes += [f"p{k} AS (SELECT substr(term, 1, {k}) AS prefix, count(*) AS n FROM {live} GROUP BY 1)", f"w{k} AS (SELECT term FROM {live} WHERE substr(term, 1, {k}) IN (SELECT prefix FROM p{k} WHERE n >= {least} AND length(prefix) = {k}))"]
        out.append(f"SELECT prefix, n FROM p{k}")
        live = f"w{k}"
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(out)}"


def tiles(s, d):
    o = table(s, d, "orders").groupBy(F.floor(C("o_orderkey") / 1000).alias("tile")).agg(F.min("o_orderkey").alias("lo"), F.max(C("o_orderkey") + F.when(C("o_orderkey") % 4000 == 999, 5).otherwise(0)).alias("last"))
    return tr.tile_ranges(o)


def record_json(s, d):
    t = tree(s, d).filter("rank IN ('kingdom', 'family')")
    kids = tree(s, d).filter("parent IS NOT NULL").groupBy(C("parent").alias("id")).agg(F.count("*").alias("k"))
    return t.join(kids, "id", "left").select("id", F.to_json(F.struct("id", "rank", C("epithet").alias("name"), F.coalesce("k", F.lit(0)).alias("children"))).alias("json"))


def split_species(s, d):
    two = F.split("epithet", " ")
    return tree(s, d).filter("rank = 'species'").select("id", two[0].alias("species"), F.when(F.size(two) > 1, F.element_at(two, -1)).alias("subspecies"))


#: A flora in SQL that both engines read: by order, a species, a subspecies without its species, one under the species before, one that bears its species' name, its child of the same rank, a species of two words.
FLORA = """SELECT 'n' || n_nationkey AS id, CAST(NULL AS VARCHAR(20)) AS parent, 'family' AS rank, 'Fam' || n_nationkey AS epithet, CAST(NULL AS VARCHAR(60)) AS prefix, CAST(NULL AS VARCHAR(60)) AS species, CAST(NULL AS VARCHAR(60)) AS below FROM {nation}
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'genus', 'Gen' || (c_custkey % 40), CAST(NULL AS VARCHAR(60)), CAST(NULL AS VARCHAR(60)), CAST(NULL AS VARCHAR(60)) FROM {customer}
UNION ALL SELECT 'o' || o_orderkey, CASE WHEN o_orderkey % 6 IN (2, 4) THEN 'o' || (o_orderkey - CASE o_orderkey % 6 WHEN 2 THEN 2 ELSE 1 END) ELSE 'c' || o_custkey END, CASE WHEN o_orderkey % 6 IN (0, 5) THEN 'species' ELSE 'subSpecies' END,
CASE o_orderkey % 6 WHEN 0 THEN 'sp' || (o_orderkey % 12) WHEN 5 THEN 'sp' || (o_orderkey % 5 * 6) || (CASE o_orderkey % 4 WHEN 1 THEN ' var. v' ELSE ' f. v' END) || (o_orderkey % 3) WHEN 3 THEN 'nom' || (o_orderkey % 4) ELSE 'ssp' || (o_orderkey % 7) END,
'Gen' || (o_custkey % 40), CASE o_orderkey % 6 WHEN 1 THEN 'sp' || (o_orderkey % 2 * 6) WHEN 2 THEN 'sp' || (o_orderkey % 12) WHEN 3 THEN 'nom' || (o_orderkey % 5) WHEN 4 THEN 'nom' || (o_orderkey % 5) END,
CASE WHEN o_orderkey % 6 = 3 THEN 'nom' || (o_orderkey % 4) WHEN o_orderkey % 6 IN (1, 2, 4) THEN 'ssp' || (o_orderkey % 7) END FROM {orders}"""
FL = "l AS (" + FLORA.format(nation="nation", customer="customer", orders="orders") + ")"
RANKED = "list_position(['" + "', '".join(tx.NAMES) + "'], {0}.rank)"
#: Fit of each record: its parent's rank is found, equal, or above genus-level for what is below species.
FIT = f"f AS (SELECT l.*, CASE WHEN l.parent IS NULL THEN 'root' WHEN p.id IS NULL THEN 'missing' WHEN {RANKED.format('l')} < {RANKED.format('p')} THEN 'inverted' WHEN l.rank = p.rank THEN 'duplicate' WHEN l.rank = 'subSpecies' AND p.rank <> 'species' THEN 'orphan' ELSE 'child' END AS fit FROM l LEFT JOIN l p ON p.id = l.parent)"
#: What is found for an orphan subspecies: the first species of its name in its genus.
HIT = "h AS (SELECT f.id, min(s.id) AS found FROM f JOIN f s ON s.parent = f.parent AND s.rank = 'species' AND s.epithet = f.species WHERE f.fit = 'orphan' GROUP BY 1)"


def flora(s, d):
    return s.sql(FLORA, **{n: table(s, d, n) for n in ("nation", "customer", "orders")}).withColumn("valid", F.lit(None).cast("string")).withColumn("name", F.lit(None).cast("string")).withColumn("genus", F.lit(None).cast("string"))


#: Paths of configured clusters: a region, a nation of another one, and a region that holds it.
PATHS = [("AMERICA.Zzz", "A"), ("AMERICA.<phylum>.<class>.<order>.Nation3.Zzz", "B"), ("EUROPE.Zzz", "C")]


def attached(s, d):
    return rp.reattached(rp.fitted(flora(s, d)))


QUERIES = {
    "e24_clusters_by_path": (lambda s, d: tr.assign_cluster_by_path(close(s, d), tree(s, d), s.createDataFrame(PATHS, "path string, cluster string")), f"WITH RECURSIVE {CL}, k AS (SELECT descendant AS id, max(CASE anc WHEN 'r1' THEN 'A' WHEN 'n3' THEN 'B' WHEN 'r3' THEN 'C' END) AS cluster FROM c WHERE anc IN ('r1', 'n3', 'r3') GROUP BY 1) SELECT t.id, coalesce(cluster, 'other') AS cluster FROM t LEFT JOIN k ON k.id = t.id"),
    "e24_kingdom_paths": (lambda s, d: tr.kingdom_paths(close(s, d), tree(s, d)), f"WITH {T} SELECT id, epithet || '.Zzz' AS path FROM t WHERE rank = 'kingdom' UNION ALL SELECT f.id, k.epithet || '.<phylum>.<class>.<order>.' || f.epithet || '.Zzz' FROM t f JOIN t k ON k.id = f.parent WHERE f.rank = 'family'"),
    "e26_cuts": (lambda s, d: tr.size_report(close(s, d), tree(s, d), 3000), f"WITH RECURSIVE {CL}, z AS (SELECT t.*, n FROM t JOIN (SELECT anc, count(*) AS n FROM c GROUP BY 1) ON anc = id), o AS (SELECT id, epithet FROM z k WHERE rank = 'kingdom' AND n >= 3000 AND NOT EXISTS (SELECT 1 FROM z f WHERE f.parent = k.id AND f.n < 3000 AND k.n < 2 * f.n)) SELECT id, epithet || '.Zzz' AS path, n AS size FROM z WHERE rank = 'kingdom' UNION ALL SELECT z.id, o.epithet || '.<phylum>.<class>.<order>.' || z.epithet || '.Zzz', n FROM z JOIN o ON o.id = z.parent WHERE rank = 'family'"),
    "c2_find_case": (lambda s, d: tr.find(tr.postings(tree(s, d)), tree(s, d).withColumn("valid", F.when(C("rank") == "species", "x")), "Genus1", "genus", "species", True, case_sensitive=True, synonyms=False).select("id"), f"WITH {T} SELECT id FROM t WHERE starts_with(epithet, 'Genus1') AND rank = 'genus'"),
    "c10_modes": (lambda s, d: functools.reduce(lambda a, m: a.join(tr.epithet_prefix_matches(tr.closure(flora(s, d)), flora(s, d), ["Gen7"], m).withColumn(m, F.lit(True)), "id", "left"), tr.MODES, flora(s, d).select("id")).filter("lenient"), f"WITH {FL}, j AS (SELECT l.id, l.rank, p.epithet AS pe, p.rank AS pr, g.epithet AS ge FROM l JOIN l p ON p.id = l.parent LEFT JOIN l g ON g.id = p.parent), k AS (SELECT id, CASE WHEN pe = 'Gen7' AND rank = 'species' THEN true END AS s, pe = 'Gen7' OR pr IN ('species', 'subSpecies') AND ge = 'Gen7' AS lenient FROM j) SELECT id, s AS strict, s AS intermediate, lenient FROM k WHERE lenient"),
    "c10_species_needed": (lambda s, d: tr.epithet_prefix_matches(tr.closure(flora(s, d)), flora(s, d), ["Gen", "SP"], "intermediate", prefix=True), f"WITH {FL} SELECT l.id FROM l JOIN l p ON p.id = l.parent WHERE p.rank = 'species' AND l.rank = 'subSpecies'"),
    "e20_complete": (lambda s, d: tr.complete(close(s, d), tree(s, d)), f"WITH RECURSIVE {CL}, k AS (SELECT descendant AS id, list(DISTINCT rank) AS r, list(DISTINCT CASE WHEN rank = 'subFamily' THEN 'family' ELSE rank END) AS g FROM c JOIN t ON t.id = anc GROUP BY 1) SELECT id, list_has_all(r, g) AND list_contains(r, 'kingdom') AS complete FROM k"),
    "e21_primary_children": (lambda s, d: tr.primary_children(close(s, d), tree(s, d)), f"WITH RECURSIVE {CL}, a AS (SELECT c.anc, c.descendant, dist, rank IN {PRIMARY} AS pri FROM c JOIN t ON t.id = anc WHERE dist > 0 AND descendant IN (SELECT id FROM t WHERE rank IN {PRIMARY})), m AS (SELECT *, min(CASE WHEN pri THEN dist END) OVER (PARTITION BY descendant) AS last FROM a) SELECT anc AS id, descendant AS child FROM m WHERE last IS NULL OR dist <= last"),
    "e23_sizes_with_synonyms": (lambda s, d: tr.subtree_sizes_with_synonyms(close(s, d), synonyms(s, d)), f"WITH RECURSIVE {CL}, y AS (SELECT 'o' || (p_partkey % 700) AS descendant, count(*) AS n FROM part GROUP BY 1) SELECT anc AS id, sum(1 + coalesce(n, 0))::BIGINT AS size FROM c LEFT JOIN y USING (descendant) GROUP BY 1"),
    "e27_synonym_prefixes": (lambda s, d: tr.postings_with_prefixes(table(s, d, "part").select(C("p_partkey").alias("id"), F.when(C("p_partkey") % 3 == 0, C("p_partkey") - 1).alias("valid"), C("p_type").alias("epithet"), F.concat(C("p_name"), F.lit(" subsp. ab")).alias("prefix"))), "SELECT regexp_replace(lower(p_type), '[^a-z0-9-]', '', 'g') AS term, 'E' AS kind, regexp_matches(p_type, '^[A-Z]') AS cap, p_partkey AS id FROM part UNION ALL SELECT term, 'P', false, id FROM (SELECT unnest(str_split(p_name, ' ')) AS term, p_partkey AS id FROM part WHERE p_partkey % 3 = 0) WHERE length(term) >= 3"),
    "e12_fits": (lambda s, d: rp.fitted(flora(s, d)).select("id", "fit", "earmarked"), f"WITH {FL}, {FIT} SELECT id, fit, id IN (SELECT parent FROM f WHERE fit = 'duplicate' AND rank = 'subSpecies') AS earmarked FROM f"),
    "e13_reattached": (lambda s, d: attached(s, d).select("id", "parent"), f"WITH {FL}, {FIT}, {HIT} SELECT f.id, CASE WHEN fit = 'missing' THEN NULL ELSE coalesce(found, parent) END AS parent FROM f LEFT JOIN h ON h.id = f.id"),
    "e14_promoted": (lambda s, d: rp.promoted(attached(s, d)).select("id", "rank", "below"), f"WITH {FL}, {FIT}, {HIT}, g AS (SELECT f.*, f.rank = 'subSpecies' AND f.species = f.below AND f.fit = 'orphan' AND f.id NOT IN (SELECT id FROM h) AND f.id IN (SELECT parent FROM f WHERE fit = 'duplicate') AS up FROM f) SELECT id, CASE WHEN up THEN 'species' ELSE rank END AS rank, CASE WHEN NOT up THEN below END AS below FROM g"),
    "e15_split": (lambda s, d: rp.split_species(flora(s, d)).select("id", "parent", "rank", "epithet", "prefix"), f"WITH {FL}, w AS (SELECT id, parent, split_part(epithet, ' ', 1) AS one, split_part(epithet, ' ', 2) AS mark, split_part(epithet, ' ', 3) AS last FROM l WHERE rank = 'species' AND epithet LIKE '% %'), h AS (SELECT w.id, one, mark, last, min(s.id) AS found FROM w JOIN l s ON s.parent = w.parent AND s.rank = 'species' AND s.epithet = one GROUP BY ALL) SELECT l.id, coalesce(found, parent) AS parent, CASE mark WHEN 'var.' THEN 'variety' WHEN 'f.' THEN 'form' ELSE rank END AS rank, coalesce(last, epithet) AS epithet, CASE WHEN found IS NULL THEN prefix ELSE prefix || ' ' || one END AS prefix FROM l LEFT JOIN h ON h.id = l.id"),
    "e16_rehung": (lambda s, d: rp.rehung(flora(s, d).withColumn("prefix", F.concat_ws(" ", "prefix", "species"))).select("id", "parent"), f"WITH {FL}, {FIT}, {HIT} SELECT l.id, coalesce(found, parent) AS parent FROM l LEFT JOIN h ON h.id = l.id"),
    "e16_plain_prefixes": (lambda s, d: rp.plain_prefixes(flora(s, d)).select("id", "prefix"), f"WITH {FL} SELECT l.id, CASE WHEN l.rank IN ('family', 'genus') OR l.prefix = p.epithet OR (p.rank = 'subSpecies' AND p.prefix = l.prefix) THEN NULL ELSE l.prefix END AS prefix FROM l LEFT JOIN l p ON p.id = l.parent"),
    "e_closure": (lambda s, d: close(s, d).withColumnRenamed("desc", "descendant"), f"WITH RECURSIVE {CL} SELECT anc, descendant, dist FROM c"),
    "e5_clean_rows": (lambda s, d: tree(s, d).select("id", F.when(C("epithet") == "incert", None).otherwise(C("parent")).alias("parent"), F.when(C("epithet") == "incert", "REMOVED").otherwise(C("rank")).alias("rank"), F.regexp_replace("epithet", "[^A-Za-z ]", "").alias("epithet")), f"WITH {T} SELECT id, CASE WHEN epithet <> 'incert' THEN parent END AS parent, CASE WHEN epithet = 'incert' THEN 'REMOVED' ELSE rank END AS rank, regexp_replace(epithet, '[^A-Za-z ]', '', 'g') AS epithet FROM t"),
    "e6_problems": (lambda s, d: tr.problems(tree(s, d), [("digit in epithet", C("epithet").rlike("[0-9]")), ("placeholder", C("epithet") == "incert"), ("no parent", C("parent").isNull() & (C("rank") != "kingdom"))]), f"WITH {T} SELECT p AS problem, count(*) AS n FROM (SELECT unnest([CASE WHEN regexp_matches(epithet, '[0-9]') THEN 'digit in epithet' END, CASE WHEN epithet = 'incert' THEN 'placeholder' END, CASE WHEN parent IS NULL AND rank <> 'kingdom' THEN 'no parent' END]) AS p FROM t) WHERE p IS NOT NULL GROUP BY 1"),
    "e7_obsolete_mappings": (lambda s, d: table(s, d, "part").select(F.concat(F.lit("c"), C("p_partkey")).alias("id")).join(tree(s, d), "id", "left_anti"), "SELECT 'c' || p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)"),
    "e9_tombstones": (lambda s, d: tree(s, d).select("id", "parent", F.when(C("epithet") == "incert", "REMOVED TAXON").otherwise("accepted").alias("status")), f"WITH {T} SELECT id, parent, CASE WHEN epithet = 'incert' THEN 'REMOVED TAXON' ELSE 'accepted' END AS status FROM t"),
    "e10_authorities": (lambda s, d: table(s, d, "part").groupBy(F.lower("p_brand").alias("authority")).agg(F.count("*").alias("n")), "SELECT lower(p_brand) AS authority, count(*) AS n FROM part GROUP BY 1"),
    "e11_redirects": (lambda s, d: tr.redirect(redirects(s, d), table(s, d, "orders").select(C("o_orderkey").alias("id"))), f"WITH RECURSIVE {RED} SELECT o_orderkey AS id, CASE WHEN e.id IS NULL THEN o_orderkey WHEN e.pt IN (SELECT id FROM l) THEN NULL ELSE e.pt END AS target FROM orders LEFT JOIN e ON e.id = o_orderkey"),
    "e12_rank_parents": (lambda s, d: tree(s, d).join(tree(s, d).select(C("id").alias("parent"), C("rank").alias("parent_rank")), "parent", "left").select("id", (tx.level(C("parent_rank")) < tx.level(C("rank"))).alias("ok")), f"WITH {T} SELECT t.id, coalesce({LEVEL.replace('rank)', 'p.rank)')}, -1) < {LEVEL.replace('rank)', 't.rank)')} AS ok FROM t LEFT JOIN t p ON p.id = t.parent"),
    "e13_orphans": (lambda s, d: tree(s, d).filter("parent IS NULL AND rank <> 'kingdom'").select("id", "epithet").join(tree(s, d).filter("parent IS NOT NULL AND rank = 'genus'").groupBy("epithet").agg(F.min("parent").alias("parent")), "epithet", "left").select("id", "parent"), f"WITH {T} SELECT a.id, b.parent FROM t a LEFT JOIN (SELECT epithet, min(parent) AS parent FROM t WHERE parent IS NOT NULL AND rank = 'genus' GROUP BY 1) b USING (epithet) WHERE a.parent IS NULL AND rank <> 'kingdom'"),
    "e14_promotion": (lambda s, d: tree(s, d).select("id", F.when((C("rank") == "subFamily") & C("epithet").rlike(" 1$"), "family").otherwise(C("rank")).alias("rank")), f"WITH {T} SELECT id, CASE WHEN rank = 'subFamily' AND epithet LIKE '% 1' THEN 'family' ELSE rank END AS rank FROM t"),
    "e15_split_species": (split_species, f"WITH {T} SELECT id, split_part(epithet, ' ', 1) AS species, CASE WHEN epithet LIKE '% %' THEN list_extract(str_split(epithet, ' '), -1) END AS subspecies FROM t WHERE rank = 'species'"),
    "e16_redundant_prefix": (lambda s, d: tree(s, d).select("id", F.regexp_replace("epithet", "^(Genus|Nation)", "").alias("epithet")), f"WITH {T} SELECT id, regexp_replace(epithet, '^(Genus|Nation)', '') AS epithet FROM t"),
    "e17_climb": (lambda s, d: tr.climb(tree(s, d)).select("id", "parent"), f"WITH RECURSIVE {CL}, k AS (SELECT descendant, arg_min(anc, dist) AS parent FROM c JOIN t a ON a.id = anc JOIN t b ON b.id = descendant WHERE dist > 0 AND {LEVEL.replace('rank)', 'a.rank)')} < {LEVEL.replace('rank)', 'b.rank)')} GROUP BY 1) SELECT id, k.parent FROM t LEFT JOIN k ON descendant = id"),
    "e18_drop_placeholders": (lambda s, d: tr.without(tree(s, d), C("epithet") == "incert").select("id", "parent"), f"WITH {T}, i AS (SELECT id FROM t WHERE epithet = 'incert') SELECT t.id, CASE WHEN t.parent IN (FROM i) THEN p.parent ELSE t.parent END AS parent FROM t LEFT JOIN t p ON p.id = t.parent WHERE t.id NOT IN (FROM i)"),
    "e20_lineage_ranks": (lambda s, d: tr.lineage_ranks(close(s, d), tree(s, d)).select("id", F.array_join("ranks", ",").alias("ranks"), (F.size(F.array_except(F.array(F.lit("kingdom"), F.lit("family")), "ranks")) == 0).alias("complete")), f"WITH RECURSIVE {CL}, k AS (SELECT descendant AS id, list_sort(list(DISTINCT rank)) AS r FROM c JOIN t ON t.id = anc GROUP BY 1) SELECT id, array_to_string(r, ',') AS ranks, list_contains(r, 'kingdom') AND list_contains(r, 'family') AS complete FROM k"),
    "e21_c5_primary_parent": (lambda s, d: tr.primary_parent(close(s, d), tree(s, d)), f"WITH RECURSIVE {CL} SELECT descendant AS id, arg_min(anc, dist) AS primary_parent FROM c JOIN t ON t.id = anc WHERE dist > 0 AND rank IN {PRIMARY} GROUP BY 1"),
    "e22_attached": (lambda s, d: tr.detached(close(s, d), tree(s, d), "kingdom"), f"WITH RECURSIVE {CL}, k AS (SELECT descendant, bool_or(rank = 'kingdom') AS attached FROM c JOIN t ON t.id = anc GROUP BY 1) SELECT attached, count(*) AS n FROM k GROUP BY 1"),
    "e23_subtree_sizes": (lambda s, d: tr.subtree_sizes(close(s, d)), f"WITH RECURSIVE {CL} SELECT anc AS id, count(*) AS size FROM c GROUP BY 1"),
    "e24_clusters": (lambda s, d: tr.assign_cluster(close(s, d), tree(s, d), tree(s, d).filter("id IN ('r1', 'r2', 'n3', 'n11')").select(C("id").alias("anc"), C("epithet").alias("cluster"))), f"WITH RECURSIVE {CL}, k AS (SELECT descendant, arg_min(epithet, dist) AS cluster FROM c JOIN t ON t.id = anc WHERE anc IN ('r1', 'r2', 'n3', 'n11') GROUP BY 1) SELECT id, coalesce(cluster, 'other') AS cluster FROM t LEFT JOIN k ON descendant = id"),
    "e25_dense_ids": (lambda s, d: tr.dense_ids(close(s, d), tree(s, d), F.substring("id", 1, 1)).select("id", "number"), f"WITH RECURSIVE {CL}, p AS (SELECT descendant AS id, list((epithet, anc) ORDER BY dist DESC) AS path FROM c JOIN t ON t.id = anc GROUP BY 1) SELECT id, (row_number() OVER (PARTITION BY substr(id, 1, 1) ORDER BY len(path), path) - 1)::INT AS number FROM p"),
    "e26_size_report": (lambda s, d: tr.subtree_sizes(close(s, d)).filter("size >= 100"), f"WITH RECURSIVE {CL} SELECT anc AS id, count(*) AS size FROM c GROUP BY 1 HAVING count(*) >= 100"),
    "e27_s9_postings": (index, f"WITH {IDX} SELECT * FROM x"),
    "e28_prefix_counts": (lambda s, d: tr.prefix_counts(words(s, d), 500, 4), sql_prefixes(500, 4)),
    "e29_s7_tile_ranges": (tiles, "WITH t AS (SELECT o_orderkey // 1000 AS tile, min(o_orderkey) AS lo, max(o_orderkey + CASE WHEN o_orderkey % 4000 = 999 THEN 5 ELSE 0 END) AS last FROM orders GROUP BY 1) SELECT *, lead(lo) OVER (ORDER BY lo) AS hi, coalesce(lag(last) OVER (ORDER BY lo) >= lo, false) AS overlaps FROM t"),
    "c1_get_by_id": (lambda s, d: table(s, d, "orders").filter("o_orderkey IN (5, 77, 900)").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (5, 77, 900)"),
    "c2_find": (lambda s, d: tr.find(tr.postings(tree(s, d)), tree(s, d), "Genus1", "genus", "species", True).select("id", "rank"), f"WITH {T} SELECT id, rank FROM t WHERE starts_with(lower(regexp_replace(epithet, '[^A-Za-z0-9-]', '', 'g')), 'genus1') AND regexp_matches(epithet, '^[A-Z]') AND rank IN ('genus', 'species')"),
    "c3_search": (lambda s, d: index(s, d).filter(C("term").startswith("re")).select("term", "id").distinct(), f"WITH {IDX} SELECT DISTINCT term, id FROM x WHERE term LIKE 're%'"),
    "c4_family": (lambda s, d: tr.family(tree(s, d), synonyms(s, d)).select("id", F.array_join("children", ",").alias("children"), F.array_join("synonyms", ",").alias("synonyms")), f"WITH {T}, k AS (SELECT parent AS id, string_agg(id, ',' ORDER BY id) AS children FROM t WHERE parent IS NOT NULL GROUP BY 1), y AS (SELECT 'o' || (p_partkey % 700) AS id, string_agg('p' || p_partkey, ',' ORDER BY 'p' || p_partkey) AS synonyms FROM part GROUP BY 1) SELECT t.id, children, synonyms FROM t LEFT JOIN k USING (id) LEFT JOIN y ON y.id = t.id"),
    "c6_descendants": (lambda s, d: tr.descendants(tree(s, d), tree(s, d).filter("id = 'r1'").select("id")).select("id").join(tree(s, d).filter("rank = 'species'").select("id"), "id", "left_semi"), f"WITH RECURSIVE {CL} SELECT id FROM c JOIN t ON id = descendant WHERE anc = 'r1' AND dist > 0 AND rank = 'species'"),
    "c7_higher_taxonomy": (lambda s, d: tr.higher_taxonomy(close(s, d), tree(s, d)).select("id", C("higher")["kingdom"].alias("kingdom"), C("higher")["family"].alias("family"), F.size("higher").alias("n")), f"WITH RECURSIVE {CL} SELECT descendant AS id, max(epithet) FILTER (WHERE rank = 'kingdom') AS kingdom, max(epithet) FILTER (WHERE rank = 'family') AS family, count(*)::INT AS n FROM c JOIN t ON id = anc WHERE dist > 0 AND rank IN {PRIMARY} GROUP BY 1"),
    "c8_names": (lambda s, d: synonyms(s, d).select("id", F.replace(F.concat_ws(" ", F.lit("Genus (A)"), F.when(F.length("epithet") > 9, F.lit("(B)")), "epithet"), F.lit(") ("), F.lit(", ")).alias("name")), "SELECT 'p' || p_partkey AS id, replace(concat_ws(' ', 'Genus (A)', CASE WHEN length(p_name) > 9 THEN '(B)' END, p_name), ') (', ', ') AS name FROM part"),
    "c10_prefix_strict": (lambda s, d: tr.prefix_matches(close(s, d), tree(s, d), ["Nation3", "Genus7"], lenient=False), f"WITH {T} SELECT o.id FROM t o JOIN t g ON g.id = o.parent JOIN t f ON f.id = g.parent WHERE g.epithet = 'Genus7' AND f.epithet = 'Nation3'"),
    "c10_prefix_lenient": (lambda s, d: tr.prefix_matches(close(s, d), tree(s, d), ["Asia", "Genus7"], lenient=True), f"WITH RECURSIVE {CL} SELECT DISTINCT a.descendant AS id FROM c a JOIN t x ON x.id = a.anc JOIN c b ON b.descendant = a.anc JOIN t y ON y.id = b.anc WHERE a.dist > 0 AND b.dist > 0 AND x.epithet = 'Genus7' AND y.epithet = 'ASIA'"),
    "s12_record_json": (record_json, f"WITH {T}, k AS (SELECT parent AS id, count(*) AS k FROM t WHERE parent IS NOT NULL GROUP BY 1) SELECT id, '{{\"id\":\"' || id || '\",\"rank\":\"' || rank || '\",\"name\":\"' || epithet || '\",\"children\":' || coalesce(k, 0) || '}}' AS json FROM t LEFT JOIN k USING (id) WHERE rank IN ('kingdom', 'family')"),
}
