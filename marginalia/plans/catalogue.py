"""Queries on a catalogue in tiles."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators import trees as tr
from ..session import table
from ..sources import catalogue as ct
from ..sources.files import shared_path

C = F.col


def _capital(name):
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 100)))


def records(s, d):
    """Regions, nations, customers and orders as kingdoms, families, genera and species, parts as synonyms of orders; ids of a rank are a range."""
    none = F.lit(None)
    of = lambda name, *cols: table(s, d, name).select(*(c.alias(n) for c, n in zip(cols, ("id", "rank", "parent", "valid", "epithet"), strict=True)))
    parts = [
        of("region", C("r_regionkey").cast("long") + 1, F.lit("kingdom"), none, none, _capital("r_name")),
        of("nation", C("n_nationkey").cast("long") + 11, F.lit("family"), C("n_regionkey").cast("long") + 1, none, _capital("n_name")),
        of("customer", C("c_custkey") + 1000, F.lit("genus"), C("c_nationkey").cast("long") + 11, none, F.concat(F.lit("Genus"), (C("c_custkey") % 500).cast("string"))),
        of("orders", C("o_orderkey") + 10_000_000, F.lit("species"), C("o_custkey") + 1000, none, F.concat(F.lit("sp"), (C("o_orderkey") % 300).cast("string"))),
    ]
    valid = table(s, d, "orders").select((C("o_orderkey") + 10_000_000).alias("valid"), C("o_orderkey").alias("p_partkey"))
    parts.append(table(s, d, "part").join(valid, "p_partkey").select((C("p_partkey") + 1_000_000_000).alias("id"), F.lit("species").alias("rank"), none.alias("parent"), "valid", C("p_name").alias("epithet")))
    rows = functools.reduce(lambda a, b: a.unionByName(b), [p.select("id", "rank", C("parent").cast("long").alias("parent"), C("valid").cast("long").alias("valid"), "epithet") for p in parts])
    lists = lambda c, n: rows.filter(C(c).isNotNull()).groupBy(C(c).alias("id")).agg(F.array_sort(F.collect_list("id")).alias(n))
    none_yet = lambda c: F.coalesce(c, F.array().cast("array<long>")).alias(c)
    joined = rows.join(lists("parent", "children"), "id", "left").join(lists("valid", "synonyms"), "id", "left")
    return joined.select("id", F.lit(None).cast("string").alias("col_id"), "rank", F.lit(True).alias("extant"), "parent", "valid", "epithet", F.when(C("rank") == "genus", F.lit('A. "B"')).alias("authority"), none_yet("children"), none_yet("synonyms"))


def catalogue(s, d, tiles=8):
    path = shared_path(s, "catalogue")
    of = records(s, d)
    ct.write(of, tr.postings(of), path, tiles)
    return ct.Catalogue(s, path)


def by_id(s, d):
    """What lines of items are of, by the orders' ids: only the tiles of orders are read."""
    cat = catalogue(s, d)
    asked = table(s, d, "lineitem").select((C("l_orderkey") + 10_000_000).alias("id"))
    return cat.records(asked).select("id", "rank", "parent", "epithet", F.size("children").alias("children"), F.size("synonyms").alias("synonyms"))


def by_term(s, d):
    cat = catalogue(s, d)
    asked = table(s, d, "nation").select(F.regexp_replace(F.lower("n_name"), "[^a-z0-9-]", "").alias("term"))
    return cat.postings(asked)


def as_json(expand):
    def run(s, d):
        cat = catalogue(s, d)
        return ct.to_json(cat, cat.all_records().select("id"), higher=True, expand=expand)

    return run


def found(s, d):
    return ct.find_json(catalogue(s, d), "Genus12", prefix=True, higher=True)


def searched(s, d):
    return ct.search_json(catalogue(s, d), "Genus7 sp29", prefix=True, expand=True)


R = """r AS MATERIALIZED (SELECT r_regionkey::BIGINT + 1 AS id, 'kingdom' AS rank, NULL::BIGINT AS parent, NULL::BIGINT AS valid, upper(r_name[1]) || lower(r_name[2:]) AS epithet FROM region
  UNION ALL SELECT n_nationkey::BIGINT + 11, 'family', n_regionkey::BIGINT + 1, NULL, upper(n_name[1]) || lower(n_name[2:]) FROM nation
  UNION ALL SELECT c_custkey + 1000, 'genus', c_nationkey::BIGINT + 11, NULL, 'Genus' || c_custkey % 500 FROM customer
  UNION ALL SELECT o_orderkey + 10000000, 'species', o_custkey + 1000, NULL, 'sp' || o_orderkey % 300 FROM orders
  UNION ALL SELECT p_partkey + 1000000000, 'species', NULL, o_orderkey + 10000000, p_name FROM part JOIN orders ON o_orderkey = p_partkey)"""
#: Records with what is linked: names, ids, and short forms, all lines being four records long at most.
J = f"""{R},
n AS MATERIALIZED (SELECT r.*, CASE WHEN r.rank = 'species' AND r.valid IS NULL THEN g.epithet || ' ' || r.epithet ELSE r.epithet END AS name, CASE WHEN r.rank = 'genus' THEN ',"authority":"A. \\"B\\""' ELSE '' END AS auth FROM r LEFT JOIN r g ON g.id = r.parent),
s AS MATERIALIZED (SELECT *, '{{"id":' || id || ',"name":"' || name || '"' || auth || ',"isSynonym":' || (valid IS NOT NULL) || ',"rank":"' || rank || '"}}' AS short FROM n),
k AS (SELECT parent AS id, string_agg(id, ',' ORDER BY id) AS ids, string_agg(short, ',' ORDER BY id) AS shorts FROM s WHERE parent IS NOT NULL GROUP BY 1),
y AS (SELECT valid AS id, string_agg(id, ',' ORDER BY id) AS ids, string_agg(short, ',' ORDER BY id) AS shorts FROM s WHERE valid IS NOT NULL GROUP BY 1),
h AS (SELECT s.id, concat_ws(',', '"' || a.rank || '":"' || a.epithet || '"', '"' || b.rank || '":"' || b.epithet || '"', '"' || c.rank || '":"' || c.epithet || '"') AS names, concat_ws(',', '"' || a.rank || '":' || a.short, '"' || b.rank || '":' || b.short, '"' || c.rank || '":' || c.short) AS shorts
  FROM s LEFT JOIN r v ON v.id = s.valid LEFT JOIN s a ON a.id = coalesce(v.parent, s.parent) LEFT JOIN s b ON b.id = a.parent LEFT JOIN s c ON c.id = b.parent),
j AS (SELECT s.*, '{{' || concat_ws(',', '"id":' || s.id || ',"name":"' || name || '"' || auth || ',"isSynonym":' || (valid IS NOT NULL), '"parentId":' || parent, '"validId":' || valid, nullif(names, ''), '"childIDs":[' || k.ids || ']', '"synonymIDs":[' || y.ids || ']', '"rank":"' || rank || '"') || '}}' AS plain,
  '{{' || concat_ws(',', '"id":' || s.id || ',"name":"' || name || '"' || auth || ',"isSynonym":' || (valid IS NOT NULL), '"parent":' || (SELECT short FROM s p WHERE p.id = s.parent), '"valid":' || (SELECT short FROM s p WHERE p.id = s.valid), nullif(h.shorts, ''), '"children":[' || k.shorts || ']', '"synonyms":[' || y.shorts || ']', '"rank":"' || rank || '"') || '}}' AS expanded,
  '{{' || concat_ws(',', '"id":' || s.id || ',"name":"' || name || '"' || auth || ',"isSynonym":' || (valid IS NOT NULL), '"parent":' || (SELECT short FROM s p WHERE p.id = s.parent), '"valid":' || (SELECT short FROM s p WHERE p.id = s.valid), '"children":[' || k.shorts || ']', '"synonyms":[' || y.shorts || ']', '"rank":"' || rank || '"') || '}}' AS bare
  FROM s LEFT JOIN k ON k.id = s.id LEFT JOIN y ON y.id = s.id LEFT JOIN h ON h.id = s.id)"""

QUERIES = {
    "s7_c1_by_id": (by_id, f"WITH {R} SELECT r.id, rank, parent, epithet, 0::INT AS children, (SELECT count(*) FROM r y WHERE y.valid = r.id)::INT AS synonyms FROM r WHERE id IN (SELECT l_orderkey + 10000000 FROM lineitem)"),
    "s7_by_term": (by_term, f"WITH {R}, t AS (SELECT regexp_replace(lower(epithet), '[^a-z0-9-]', '', 'g') AS term, 'E' AS kind, regexp_matches(epithet, '^[A-Z]') AS cap, id FROM r UNION SELECT unnest(regexp_extract_all(lower(epithet), '[a-z0-9-]+')), 'P', regexp_matches(epithet, '^[A-Z]'), id FROM r) SELECT * FROM t WHERE term IN (SELECT regexp_replace(lower(n_name), '[^a-z0-9-]', '', 'g') FROM nation) AND (kind = 'E' OR length(term) >= 3)"),
    "s12_by_id": (as_json(False), f"WITH {J} SELECT id, plain AS json FROM j"),
    "s12_by_id_expanded": (as_json(True), f"WITH {J} SELECT id, expanded AS json FROM j"),
    "s12_find": (found, f"WITH {J} SELECT id, plain AS json FROM j WHERE starts_with(epithet, 'Genus12')"),
    "s12_search": (searched, f"WITH {J} SELECT j.id, j.bare AS json FROM j JOIN r p ON p.id = j.parent WHERE starts_with(j.epithet, 'sp29') AND starts_with(p.epithet, 'Genus7')"),
}
