"""Queries on cleaning: taxon rows of twelve kinds made from parts, and rules, a good many of them for single rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..session import table

C = F.col
#: In SQL that both engines read: two words of a part's name, the kind of its row, and the row.
WORDS = "SELECT p_partkey, CAST(p_partkey % 12 AS INT) AS k, p_partkey % 30 = 5 AS ruled, concat(upper(substr(p_name, 1, 1)), substr(regexp_replace(p_name, '[^a-z].*', ''), 2, 99), 'us') AS g, concat(regexp_replace(p_name, '.*[^a-z]|[0-9]', ''), 'um') AS s FROM {part}"
ROWS = """SELECT CAST(p_partkey AS VARCHAR(20)) AS id, concat('p', p_partkey) AS parent, concat('v', p_partkey) AS valid, CASE WHEN k = 1 THEN 'misapplied' ELSE 'accepted' END AS status, CASE WHEN k = 0 THEN 'ICVCN' ELSE 'ICZN' END AS code,
CASE k WHEN 2 THEN 'Family' WHEN 4 THEN 'subsp.' WHEN 7 THEN 'what' WHEN 8 THEN 'section' WHEN 9 THEN 'Variety' WHEN 11 THEN 'spec.' WHEN 5 THEN 'species' WHEN 6 THEN 'Species' WHEN 10 THEN 'species' ELSE 'genus' END AS rank,
CASE k WHEN 2 THEN concat(g, 'idae lindley, 1836') WHEN 4 THEN concat(g, ' ', s, ' subsp. minor Doe, 18999') WHEN 6 THEN concat(g, ' (Sub) ', s, ' (de la Cruz,1768)') WHEN 8 THEN concat(g, ' (sect. Bar)  Doe') WHEN 10 THEN concat('Ü', g, ' ', s, ' Doe') WHEN 3 THEN concat(g, ' Mill.') ELSE concat(g, ' ', s, ' Doe') END AS name,
CASE WHEN k IN (4, 5, 11) THEN g WHEN k = 10 THEN concat('Ü', g) END AS genus, CASE WHEN k IN (4, 5, 9, 11) THEN s END AS species, CASE WHEN k = 4 THEN 'minor' END AS below, 'published' AS published, 'remarks' AS remarks, '' AS "references" FROM w"""


def words(s, d):
    return s.sql(WORDS.replace("p_partkey, CAST", "p_partkey, p_name, CAST"), part=table(s, d, "part"))


def rows(s, d):
    text = "WITH w AS (" + WORDS + ") " + ROWS.replace('"references"', "`references`").replace("VARCHAR(20)", "STRING")
    return s.sql(text, part=table(s, d, "part"))


def rules(s, d):
    """A name for each thirtieth row, every 24th one removed, a spelling of a rank, and a letter."""
    p = table(s, d, "part")
    none = F.lit(None).cast("string")
    of = lambda df, *cols: df.select(*(c.cast(t).alias(n) for c, n, t in zip(cols, ("ord", "key", "field", "kind", "value", "replacement"), ("long", *["string"] * 5), strict=True)))
    key = C("p_partkey").cast("string")
    made = of(p.filter("p_partkey % 30 = 5"), C("p_partkey"), key, F.lit("name"), F.lit("key"), F.lit(""), F.lit("Ruled name Doe"))
    made = made.unionByName(of(p.filter("p_partkey % 24 = 11"), C("p_partkey"), key, F.lit(""), F.lit("remove"), F.lit("REMOVE"), F.lit("")))
    return made.unionByName(of(s.range(1), C("id"), F.lit(""), F.lit("rank"), F.lit("literal"), F.lit("spec."), F.lit("species"))).unionByName(of(s.range(1), C("id"), none, none, F.lit("character"), F.lit("Ü"), F.lit("U")))


def cleaned(s, d):
    return cl.clean(rows(s, d), rules(s, d)).withColumn("problems", F.array_join("problems", "; "))


def names(s, d):
    return cl.normalised(rows(s, d).select("id", "name", "rank"), ["name", "rank"], rules(s, d))


W = "w AS (" + WORDS.format(part="part") + "), r AS (" + ROWS + ")"
GONE = "(k IN (0, 1, 7, 9) OR p_partkey % 24 = 11)"
#: A ruled row is one of kind 5 or 11.
NAME = "CASE WHEN ruled THEN 'Ruled name Doe' WHEN k = 2 THEN g || 'idae Lindley, 1836' WHEN k = 4 THEN g || ' ' || s || ' subsp. minor Doe, 18999' WHEN k = 6 THEN g || ' (Sub) ' || s || ' (de la Cruz, 1768)' WHEN k = 8 THEN g || ' (sect. Bar) Doe' WHEN k = 10 THEN 'U' || lower(g) || ' ' || s || ' Doe' WHEN k = 3 THEN g || ' Mill.' ELSE g || ' ' || s || ' Doe' END"

QUERIES = {
    "e1_s4_rules": (names, f"WITH {W} SELECT id, CASE WHEN p_partkey % 30 = 5 THEN 'Ruled name Doe' ELSE replace(replace(replace(name, 'Ü', 'U'), ',1768', ', 1768'), '  ', ' ') || CASE WHEN k = 3 THEN ' ' ELSE '' END END AS name, CASE WHEN rank = 'spec.' THEN 'species' ELSE CASE WHEN rank = 'subsp.' THEN 'subsp. ' ELSE rank END END AS rank FROM r JOIN w ON id = p_partkey::VARCHAR"),
    "e5_e9_cleaned": (cleaned, f"""WITH {W}, c AS (SELECT *, {GONE} AS gone, (['x', 'x', 'family', 'genus', 'subSpecies', 'species', 'species', 'x', 'section', 'x', 'species', 'species'])[k + 1] AS rk, {NAME} AS nm FROM w)
SELECT r.id, r.parent, r.valid, CASE WHEN gone THEN 'REMOVED TAXON' ELSE 'accepted' END AS status, CASE WHEN NOT gone THEN code END AS code, CASE WHEN NOT gone THEN rk END AS rank, CASE WHEN NOT gone THEN nm END AS name, CASE WHEN NOT gone AND k <> 2 THEN CASE WHEN k = 10 THEN 'U' || lower(g) ELSE g END END AS genus, CASE WHEN NOT gone AND k IN (4, 5, 6, 10, 11) THEN s END AS species, CASE WHEN NOT gone AND k = 4 THEN 'minor' END AS below,
NULL::VARCHAR AS published, NULL::VARCHAR AS remarks, NULL::VARCHAR AS "references", CASE WHEN NOT gone THEN CASE k WHEN 2 THEN 'Lindley, 1836' WHEN 3 THEN 'Mill.' WHEN 4 THEN 'Doe, 18999' WHEN 6 THEN '(de la Cruz, 1768)' ELSE 'Doe' END END AS authority,
CASE WHEN NOT gone THEN CASE WHEN ruled THEN 'unmatched genus ''' || g || '''; unmatched species ''' || s || '''' WHEN k = 4 THEN 'broken year ''Doe, 18999''' WHEN k = 10 THEN 'invalid genus ''U' || g || '''' ELSE '' END END AS problems FROM c JOIN r ON r.id = p_partkey::VARCHAR"""),
}
