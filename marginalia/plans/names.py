"""Queries on names and abbreviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import abbrev as ab
from ..operators import names as nm
from ..operators import tokens as tk
from ..session import table

C = F.col
TOK = r"[\p{L}\p{M}]+|[0-9]+|[^\s\p{L}\p{M}0-9]"
#: Author lists in SQL that both engines read.
PEOPLE = """SELECT o_orderkey AS doc_id, 'by ' || CASE o_orderkey % 5 WHEN 0 THEN 'Doe, J. K.' WHEN 1 THEN 'J. van der Berg' WHEN 2 THEN 'Anna Smith' WHEN 3 THEN 'Garcia de la Cruz, M.' ELSE 'Smith, Anna' END || ' in ' || (o_orderkey % 90) || ' ''Old Joe'' XYZ' AS text FROM {orders}"""


def people(s, d):
    return tk.tokens(s.sql(PEOPLE, orders=table(s, d, "orders")))


def docs(s, d):
    return tk.tokens(table(s, d, "documents"))


SQL_DOCS = f"t AS (SELECT doc_id, regexp_extract_all(text, '{TOK}') AS a FROM documents), tok AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS tok FROM t)"
PART = "(" + ", ".join(f"'{p}'" for p in nm.PARTICLES) + ")"
VOWEL = "regexp_matches(tok, '^\\p{Lu}\\p{Ll}+$') AND regexp_matches(lower(tok), '[aeiouyàáâäãåæèéêëìíîïòóôöõøùúûü]')"
PERSON = "(['Doe , J . K .', 'J . van der Berg', 'Anna Smith', 'Garcia de la Cruz , M .', 'Smith , Anna'])[o_orderkey % 5 + 1]"
ORDER = "(['last initials', 'initials last', 'first last', 'last initials', 'last first'])[o_orderkey % 5 + 1]"
#: References with numberings, numbered paragraphs.
REFS = """SELECT o_custkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Fig.' WHEN 1 THEN 'Tab.' ELSE 'Pl.' END AS prefix, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 9 + 1 AS VARCHAR(30)) WHEN 1 THEN (o_orderkey % 9 + 1) || '-' || (o_orderkey % 9 + 3) WHEN 2 THEN (o_orderkey % 9 + 1) || ', ' || (o_orderkey % 9 + 2) || ' and ' || (o_orderkey % 9 + 5) ELSE '9-2' END AS numbering, o_orderkey AS k FROM {orders}"""
R = "r AS (" + REFS.format(orders="orders") + ")"
NUMS = "CASE k % 4 WHEN 0 THEN [k % 9 + 1] WHEN 1 THEN [k % 9 + 1, k % 9 + 2, k % 9 + 3] WHEN 2 THEN [k % 9 + 1, k % 9 + 2, k % 9 + 5] ELSE [] END"
PARS = """SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS par, o_orderkey AS k FROM {orders}"""
P = "p0 AS (" + PARS.format(orders="orders") + "), p AS (SELECT doc_id, par, CASE WHEN k % 5 = 0 THEN 'no number' WHEN par > 6 THEN '(' || par || ') item a: x' ELSE par || '. item b; y' END AS text, k FROM p0)"


def refs(s, d):
    return s.sql(REFS, orders=table(s, d, "orders"))


def pars(s, d):
    p = s.sql(PARS, orders=table(s, d, "orders")).withColumn("par", C("par").cast("int"))
    text = F.when(C("k") % 5 == 0, "no number").when(C("par") > 6, F.concat(F.lit("("), C("par").cast("string"), F.lit(") item a: x"))).otherwise(F.concat(C("par").cast("string"), F.lit(". item b; y")))
    return p.withColumn("text", text)


def known(s, d):
    """Abbreviations of each nation: nested prefixes of three lengths."""
    c = table(s, d, "customer").select(C("c_nationkey").alias("doc_id"), F.lower("c_mktsegment").alias("v"))
    return c.select("doc_id", F.explode(F.array(F.substring("v", 1, 2), F.substring("v", 1, 4), C("v"))).alias("value")).distinct()


KN = "kn AS (SELECT DISTINCT c_nationkey AS doc_id, unnest([substr(lower(c_mktsegment), 1, 2), substr(lower(c_mktsegment), 1, 4), lower(c_mktsegment)]) AS value FROM customer)"


def entries(s, d):
    return known(s, d).select("doc_id", F.concat("value", F.lit(".")).alias("key"), F.upper("value").alias("value"))


def details(s, d):
    return table(s, d, "orders").select(C("o_custkey").alias("doc_id"), C("o_orderkey").alias("ord"), C("o_orderstatus").alias("type"), F.lit("price").alias("attr"), F.floor("o_totalprice").cast("string").alias("value"))


def levels(s, d):
    return table(s, d, "orders").select(C("o_custkey").alias("doc_id"), C("o_orderkey").alias("ord"), (C("o_orderkey") % 3).cast("int").alias("level"), C("o_orderstatus").alias("text"))


QUERIES = {
    "n2_n8_acronyms": (lambda s, d: nm.acronyms(docs(s, d)), f"WITH {SQL_DOCS} SELECT doc_id, pos::INT AS start, (pos + 1)::INT AS \"end\", tok AS value FROM tok WHERE regexp_matches(tok, '^\\p{{Lu}}{{3,}}$')"),
    "n1_name_style": (lambda s, d: nm.in_style(nm.persons(people(s, d)).filter("start < 3"), nm.NameStyle(orders=("initials last", "last initials"), particles=True)).select("doc_id", "value"), f"SELECT o_orderkey AS doc_id, {PERSON} AS value FROM orders WHERE o_orderkey % 5 IN (1, 3)"),
    "n3_particle_runs": (lambda s, d: nm.particle_runs(docs(s, d)), f"WITH {SQL_DOCS}, h AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM tok WHERE lower(tok) IN {PART}) SELECT doc_id, min(pos)::INT AS start, (max(pos) + 1)::INT AS \"end\", string_agg(tok, ' ' ORDER BY pos) AS value, regexp_matches(string_agg(tok, ' ' ORDER BY pos), '^\\p{{Lu}}') AS upper FROM h GROUP BY doc_id, g"),
    "n4_last_names": (lambda s, d: docs(s, d).filter(nm.is_last_name(C("tok"))).groupBy("tok").agg(F.count("*").alias("n")), f"WITH {SQL_DOCS} SELECT tok, count(*) AS n FROM tok WHERE {VOWEL} GROUP BY 1"),
    "n5_persons": (lambda s, d: nm.persons(people(s, d)).filter("start < 3").select("doc_id", "value", "part_order"), f"SELECT o_orderkey AS doc_id, {PERSON} AS value, {ORDER} AS part_order FROM orders"),
    "n6_name_attributes": (lambda s, d: nm.attributes(nm.persons(people(s, d)).filter("start < 3")), f"SELECT o_orderkey AS doc_id, {ORDER} AS part_order, (['dotted', 'dotted', 'none', 'dotted', 'none'])[o_orderkey % 5 + 1] AS initials FROM orders"),
    "n7_proper_names": (lambda s, d: nm.proper_names(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(C("end") - C("start")).alias("tokens")), f"WITH {SQL_DOCS}, k AS (SELECT doc_id, pos, CASE WHEN lower(tok) IN {PART} AND regexp_matches(tok, '^\\p{{Ll}}') THEN 's' WHEN lower(tok) IN ('jr', 'sr', 'ii', 'iii', 'iv') THEN 'a' WHEN regexp_matches(tok, '^\\p{{Lu}}$') THEN 'i' WHEN {VOWEL} THEN 'n' ELSE '_' END AS k FROM tok), l AS (SELECT doc_id, string_agg(k, '' ORDER BY pos) AS code FROM k GROUP BY 1), h AS (SELECT doc_id, regexp_extract_all(code, 'n(?:s*n)*') AS h FROM l) SELECT doc_id, len(h) AS n, list_sum(list_transform(h, lambda x: length(x)))::BIGINT AS tokens FROM h WHERE len(h) > 0"),
    "n9_aliases": (lambda s, d: nm.aliases(people(s, d)).select("doc_id", "value"), "SELECT o_orderkey AS doc_id, ''' Old Joe ''' AS value FROM orders"),
    "a1_number_runs": (lambda s, d: ab.number_runs(pars(s, d)), f"WITH {P}, h AS (SELECT doc_id, par, CASE WHEN par > 6 THEN ')' ELSE '.' END AS sign FROM p WHERE text <> 'no number'), g AS (SELECT *, par - row_number() OVER (PARTITION BY doc_id, sign ORDER BY par) AS g FROM h) SELECT doc_id, min(par)::INT AS first, max(par)::INT AS last, 'arabic' AS script, sign FROM g GROUP BY doc_id, sign, g HAVING count(*) > 1"),
    "a2_strict_relaxed": (lambda s, d: ab.strict_and_relaxed(pars(s, d), "item ([a-z]):", "item ([a-z]);"), f"WITH {P}, m AS (SELECT *, text LIKE '%item a:%' AS s FROM p), n AS (SELECT *, lag(s) OVER w AS b, lead(s) OVER w AS f FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY par)) SELECT doc_id, par::INT AS par, CASE WHEN s THEN 'a' ELSE 'b' END AS value FROM n WHERE s OR (coalesce(b, false) AND coalesce(f, false) AND text LIKE '%item b;%')"),
    "a3_prefixes": (lambda s, d: ab.prefix_candidates(known(s, d)), f"WITH {KN} SELECT DISTINCT doc_id, substr(value, 1, k::INT) AS value FROM kn, unnest(range(1, length(value))) AS t(k)"),
    "a4_parents": (lambda s, d: ab.parents(known(s, d)), f"WITH {KN} SELECT a.doc_id, a.value, max_by(b.value, length(b.value)) FILTER (WHERE b.value <> a.value) AS parent, count(*)::INT AS level FROM kn a JOIN kn b ON a.doc_id = b.doc_id AND starts_with(a.value, b.value) GROUP BY 1, 2"),
    "a5_implied_text": (lambda s, d: ab.inherit_text(levels(s, d)).select("doc_id", "ord", "implied"), "WITH RECURSIVE e AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, o_orderkey % 3 AS level, o_orderstatus AS text FROM orders), p AS (SELECT a.*, (SELECT max(b.ord) FROM e b WHERE b.doc_id = a.doc_id AND b.ord < a.ord AND b.level < a.level) AS up FROM e a), w(doc_id, ord, up, text) AS (SELECT doc_id, ord, up, text FROM p UNION ALL SELECT w.doc_id, w.ord, p.up, p.text || ' ' || w.text FROM w JOIN p ON p.ord = w.up) SELECT doc_id, ord, text AS implied FROM w WHERE up IS NULL"),
    "a6_schemes": (lambda s, d: ab.schemes(docs(s, d)), f"WITH {SQL_DOCS}, c AS (SELECT doc_id, CASE WHEN regexp_matches(tok, '^[0-9]+$') THEN 'arabic' WHEN regexp_matches(upper(tok), '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') THEN 'roman' WHEN regexp_matches(tok, '^[A-Za-z]$') THEN 'letter' END AS scheme FROM tok), s AS (SELECT doc_id, scheme, count(*) AS score FROM c WHERE scheme IS NOT NULL GROUP BY 1, 2) SELECT * FROM s QUALIFY score * 5 > max(score) OVER (PARTITION BY doc_id)"),
    "a7_combine": (lambda s, d: refs(s, d).select("k", ab.combine(C("numbering")).alias("numbering")), f"WITH {R} SELECT k, CASE k % 4 WHEN 0 THEN (k % 9 + 1)::VARCHAR WHEN 1 THEN (k % 9 + 1) || '-' || (k % 9 + 3) WHEN 2 THEN (k % 9 + 1) || '-' || (k % 9 + 2) || ',' || (k % 9 + 5) ELSE '' END AS numbering FROM r"),
    "a8_numbering_score": (lambda s, d: refs(s, d).select("k", ab.score(C("numbering")).alias("score")), f"WITH {R} SELECT k, CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 0 END AS score FROM r"),
    "a9_with_ranges": (lambda s, d: ab.with_ranges(refs(s, d)).select("k"), f"WITH {R} SELECT k FROM r WHERE (doc_id, prefix) IN (SELECT (doc_id, prefix) FROM r WHERE k % 4 IN (1, 2))"),
    "a10_a16_expand": (lambda s, d: ab.expand(refs(s, d)), f"WITH {R} SELECT DISTINCT doc_id, prefix, unnest({NUMS})::INT AS n FROM r"),
    "a11_format_number": (lambda s, d: table(s, d, "orders").select("o_orderkey", *(ab.format_number(F.expr("CAST(o_orderkey % 30 + 1 AS INT)"), F.lit(k)).alias(f"x{i}") for i, k in enumerate(("arabic", "ROMAN", "letter")))), "WITH n AS (SELECT o_orderkey, o_orderkey % 30 + 1 AS n FROM orders) SELECT o_orderkey, n::VARCHAR AS x0, repeat('X', (n // 10)::INT) || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS x1, CASE WHEN n <= 26 THEN chr(96 + n::INT) END AS x2 FROM n"),
    "a13_resolve": (lambda s, d: ab.resolve(table(s, d, "customer").select("c_custkey", C("c_nationkey").alias("doc_id"), F.when(C("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit("."))).otherwise(F.upper("c_mktsegment")).alias("key")), entries(s, d)).select("c_custkey", "value"), "SELECT c_custkey, upper(c_mktsegment) AS value FROM customer"),
    "a14_parse_number": (lambda s, d: docs(s, d).select(ab.parse_number(C("tok"), F.lit("roman")).alias("r"), ab.parse_number(C("tok"), F.lit("letter")).alias("l")).filter("r > 0 OR l > 0").groupBy("l").agg(F.count("*").alias("n"), F.sum((C("r") > 0).cast("long")).alias("roman")), f"WITH {SQL_DOCS}, x AS (SELECT regexp_matches(upper(tok), '^M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})$') AS r, CASE WHEN regexp_matches(tok, '^[a-z]$') THEN ascii(tok) - 96 ELSE -1 END AS l FROM tok) SELECT l::INT AS l, count(*) AS n, sum(r::INT)::BIGINT AS roman FROM x WHERE r OR l > 0 GROUP BY 1"),
    "a15_tag_references": (lambda s, d: ab.tag_references(docs(s, d), docs(s, d).filter("pos = 0").select("doc_id", F.concat("tok", F.lit(".")).alias("key")), docs(s, d).filter("pos < 10").select("doc_id", "pos")), f"WITH {SQL_DOCS} SELECT a.doc_id, a.pos::INT AS pos, a.tok FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = 0 AND b.tok = a.tok WHERE a.pos >= 10 AND a.tok <> '.' UNION ALL SELECT a.doc_id, a.pos::INT, a.tok FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = 0 AND b.tok = '.' AND a.tok = '.' WHERE a.pos >= 10"),
    "a17_augment": (lambda s, d: ab.augment(details(s, d)).select("doc_id", F.size("attrs").alias("n"), C("attrs")["F--price"].alias("one"), C("attrs")["F--2--price"].alias("two")), "WITH f AS (SELECT o_custkey AS doc_id, o_orderstatus AS t, floor(o_totalprice)::BIGINT::VARCHAR AS v, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)) SELECT doc_id, count(*)::INT AS n, max(v) FILTER (WHERE t = 'F' AND n = 1) AS one, max(v) FILTER (WHERE t = 'F' AND k = 2) AS two FROM f GROUP BY 1"),
    "a18_implied": (lambda s, d: ab.implied(ab.augment(details(s, d))).select("doc_id", "type", "k", "value"), "SELECT o_custkey AS doc_id, o_orderstatus AS type, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)::INT AS k, floor(o_totalprice)::BIGINT::VARCHAR AS value FROM orders"),
}
