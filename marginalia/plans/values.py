"""Queries on script values, countries, taxonomic names and value cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxa as x
from ..functions import values as v
from ..operators import geo
from ..operators import markup as mk
from ..session import table

C = F.col


def events(s, d):
    return table(s, d, "events")


def parts(s, d):
    return table(s, d, "part")


#: Taxonomic names in SQL that both engines read: genus from the brand, species and lower epithets from the name.
TAXA = """SELECT p_partkey AS id, 'Gen' || lower(p_type) AS genus, CASE WHEN p_size % 3 = 0 THEN 'Sub' || (p_size % 9 + 1) END AS subgenus, CASE WHEN p_size % 5 > 0 THEN split_part(p_name, ' ', 1) END AS species,
CASE WHEN p_size % 5 = 1 THEN split_part(p_name, ' ', 2) END AS subspecies, CASE WHEN p_size % 5 = 2 THEN split_part(p_name, ' ', 2) END AS variety, p_size % 2 = 0 AS hybrid,
CASE p_size % 4 WHEN 0 THEN '(Clement, 1924)' WHEN 1 THEN '(Clement, 1924) Miller, 2013' WHEN 2 THEN 'Miller, 2013' ELSE '(Clement) 1924' END AS authority FROM {part}"""
T = "t AS (" + TAXA.format(part="part") + ")"


def taxa(s, d):
    t = s.sql(TAXA, part=parts(s, d))
    pairs = [x_ for n, c in (("genus", "genus"), ("subGenus", "subgenus"), ("species", "species"), ("subSpecies", "subspecies"), ("variety", "variety")) for x_ in (F.lit(n), C(c))]
    return t.withColumn("e", F.map_filter(F.create_map(*pairs), lambda k, y: y.isNotNull()))


SQL_NAME = "CASE WHEN subgenus IS NULL AND species IS NULL THEN genus ELSE concat_ws(' ', genus, CASE WHEN species IS NULL AND {h} THEN '× ' ELSE '' END || '(' || subgenus || ')', CASE WHEN subspecies IS NULL AND variety IS NULL AND {h} THEN '× ' ELSE '' END || species, CASE WHEN {h} THEN '× ' ELSE '' END || 'subsp. ' || subspecies, CASE WHEN {h} THEN '× ' ELSE '' END || 'var. ' || variety) END"
SQL_RANK = "CASE WHEN variety IS NOT NULL THEN 'variety' WHEN subspecies IS NOT NULL THEN 'subSpecies' WHEN species IS NOT NULL THEN 'species' WHEN subgenus IS NOT NULL THEN 'subGenus' ELSE 'genus' END"
BASE = "CASE authority WHEN '(Clement, 1924) Miller, 2013' THEN '(Clement, 1924)' WHEN 'Miller, 2013' THEN NULL ELSE '(Clement, 1924)' END"
RANK_SQL = "CASE p_size % 5 WHEN 0 THEN 'genus' WHEN 1 THEN 'subSpecies' WHEN 2 THEN 'variety' WHEN 3 THEN 'subFamily' ELSE 'what' END"


def collapse(sql: str) -> str:
    for a in "abcdefhilmnoqrsuvwx":
        sql = f"regexp_replace({sql}, '{a}{a}+', '{a}', 'g')"
    return sql


FUZZY = collapse("translate(regexp_replace(lower(p_name || p_type), '[^a-z]', '', 'g'), 'pgktjyz', 'bccdiis')")
NATION = "CASE n_nationkey % 3 WHEN 0 THEN 'Nátion ' WHEN 1 THEN 'Country of ' ELSE 'Isle ' END || chr(CAST(65 + n_nationkey AS INT)) || chr(CAST(97 + n_nationkey AS INT))"
ASKED = "CASE c_custkey % 4 WHEN 0 THEN upper(n) WHEN 1 THEN replace(n, 'á', 'a') WHEN 2 THEN replace(n, 'C', 'K') ELSE 'Nowhere' END"
N = f"n AS (SELECT n_nationkey, {NATION} AS n FROM nation), a AS (SELECT c_custkey, n, {ASKED} AS q FROM customer JOIN n ON n_nationkey = c_nationkey)"


def nations(s, d):
    return table(s, d, "nation").select("n_nationkey", F.expr(NATION).alias("name"))


def asked(s, d):
    return table(s, d, "customer").join(F.broadcast(nations(s, d)), C("c_nationkey") == C("n_nationkey")).withColumnRenamed("name", "n").select("c_custkey", F.expr(ASKED).alias("q"))


VALUE = "concat(p_name, ' ,', lower(p_type), '( ', p_brand, ' );x.', p_size)"
CLEAN = "replace(p_name || ', ' || lower(p_type) || '(' || p_brand || '); ', '#', 'No')"
PATTERNS = [("small .*", "tiny"), ("x\\. [0-9]+", "$__$"), ("red", "$_rubra_$")]


def cleaned(s, d):
    value = v.normalise(C("p_partkey").cast("string"), "name", F.expr(VALUE), {"7": {"name": "seven"}}, {"name": {"blue bolt ,steel( Brand#1 );x.3": "known"}}, [("#", "No")], PATTERNS)
    return parts(s, d).select("p_partkey", value.alias("value"))


SEG = "CASE p_size % 4 WHEN 0 THEN 'Abies' WHEN 1 THEN 'Abies ' || split_part(p_name, ' ', 1) || ' Mill.' WHEN 2 THEN 'Abies alba var. ' || split_part(p_name, ' ', 2) || ' (L.) Mill.' ELSE 'Abies L.' END"

def dwc(s, d):
    xml = F.when(C("id") % 2 == 0, x.to_dwc(C("e"), C("authority"), simple=True)).otherwise(x.to_dwc(C("e"), C("authority")))
    back = taxa(s, d).select("id", xml.alias("xml")).withColumn("n", x.from_dwc(C("xml")))
    return back.select("id", *(C("n")["epithets"][r].alias(r.lower()) for r in ("genus", "subGenus", "species", "subSpecies", "variety")), C("n")["authority"].alias("authority"), F.nullif(F.regexp_extract("xml", "<(dwc:[sS]pecies\\w*)>", 1), F.lit("")).alias("element"))


def tagged_names(s, d):
    """Names tagged in text: some attributes are stated, the rest is told by the text."""
    more = F.create_map(F.lit("hybrid"), F.when(C("hybrid"), "x"), F.lit("authorityName"), F.when(C("id") % 3 == 0, "Stated"), F.lit("authorityYear"), F.when(C("id") % 5 == 0, "1888"))
    attributes = F.map_concat("e", F.map_filter(more, lambda _, y: y.isNotNull()))
    text = F.concat_ws(" ", "genus", "subgenus", "species", "subspecies", "variety", "authority")
    n = mk.names_from_attributes(taxa(s, d).select("id", attributes.alias("a"), text.alias("t")), "a", "t").select("id", "name.*")
    return n.select("id", C("epithets")[x.most_significant_rank(C("epithets"))].alias("epithet"), "hybrid", "name", "year", "base_name", "base_year")


QUERIES = {
    "m1_coercions": (lambda s, d: events(s, d).select("event_id", v.number_to_boolean(C("value") - 20).alias("positive"), v.string_to_boolean(F.when(C("event_type") != "view", C("event_type")).otherwise("")).alias("some"), F.floor(F.when(F.isnan(v.string_to_number(F.get_json_object("props", "$.k"))), -1).otherwise(v.string_to_number(F.get_json_object("props", "$.k")))).alias("k"), F.isnan(v.string_to_number(C("event_type"))).alias("nan"), v.array_to_string(F.split("event_type", "i")).alias("first"), v.map_to_number(F.create_map(F.lit("a"), C("value"))).alias("n")), "SELECT event_id, value - 20 > 0 AS positive, event_type <> 'view' AS some, json_extract(props, '$.k')::BIGINT AS k, true AS nan, split_part(event_type, 'i', 1) AS first, 1.0::DOUBLE AS n FROM events"),
    "m2_arrays_maps": (lambda s, d: events(s, d).withColumn("m", F.create_map(F.lit("type"), C("event_type"))).select("event_id", v.put(C("m"), F.lit("type"), F.lit("x"))["type"].alias("set"), v.put(C("m"), F.lit("type"), F.lit("x"), overwrite=False)["type"].alias("kept"), F.size(v.put(C("m"), F.lit("user"), F.lit("u"))).alias("n"), F.array_join(F.array_remove(F.array(F.lit("view"), C("event_type")), "view"), ",").alias("rest"), F.array_join(F.array_union(F.array(F.lit("view")), F.array("event_type")), ",").alias("both")), "SELECT event_id, 'x' AS \"set\", event_type AS kept, 2 AS n, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS rest, CASE WHEN event_type = 'view' THEN 'view' ELSE 'view,' || event_type END AS both FROM events"),
    "m3_compare": (lambda s, d: events(s, d).withColumn("o", F.when(C("event_id") % 3 > 0, 20.0)).select("event_id", v.compare(C("o"), C("value")).alias("c"), v.compare(C("o"), F.lit(None).cast("double")).alias("n"), v.compare_arrays(F.split("event_type", "e"), F.split("event_type", "c")).alias("a")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE sign(20.0::DOUBLE - value)::INT END AS c, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n, sign(len(str_split(event_type, 'e')) - len(str_split(event_type, 'c')))::INT AS a FROM events"),
    "m4_annotations": (lambda s, d: events(s, d).select("user_id", "event_type", "event_id").filter("event_type = 'view'").unionByName(events(s, d).filter("event_type = 'click'").select("user_id", F.lit("tap").alias("event_type"), "event_id")).groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "SELECT user_id, CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END AS event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2"),
    "r1_is_country": (lambda s, d: asked(s, d).join(F.broadcast(nations(s, d)), geo.is_country(C("q"), C("name"))).select("c_custkey", "name"), f"WITH {N} SELECT c_custkey, n AS name FROM a WHERE c_custkey % 4 = 0 OR (c_custkey % 4 IN (1, 2) AND lower(q) = lower(n))"),
    "r2_country_names": (lambda s, d: geo.country_names(asked(s, d), "q", nations(s, d)).select("c_custkey", "country"), f"WITH {N} SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'Nowhere' ELSE n END AS country FROM a"),
    "r3_fuzzy_key": (lambda s, d: parts(s, d).select("p_partkey", v.fuzzy_key(F.concat("p_name", "p_type")).alias("fuzzy")), f"SELECT p_partkey, {FUZZY} AS fuzzy FROM part"),
    "r4_region_languages": (lambda s, d: geo.regions_in(table(s, d, "customer").select("c_custkey", F.array(F.when(C("c_custkey") % 3 == 0, "German").when(C("c_custkey") % 3 == 1, "official").otherwise("Welsh"), F.lit("Veps")).alias("languages")), ["German"]).select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey % 3 < 2"),
    "r4_region_handler": (lambda s, d: table(s, d, "nation").select("n_nationkey", geo.region_handler(F.when(C("n_nationkey") % 2 == 0, "ABC"), C("n_name")).alias("code")), "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'ABC' ELSE 'NI-NATION' END AS code FROM nation"),
    "r5_region_types": (lambda s, d: table(s, d, "nation").join(F.broadcast(table(s, d, "region")), C("n_regionkey") == C("r_regionkey"), "left").select("n_name", F.coalesce(F.when(C("r_regionkey") < 3, C("r_name")), C("n_name")).alias("name"), F.when(C("r_regionkey") < 3, "region").alias("type")), "SELECT n_name, CASE WHEN n_regionkey < 3 THEN r_name ELSE n_name END AS name, CASE WHEN n_regionkey < 3 THEN 'region' END AS type FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "x1_significant_rank": (lambda s, d: taxa(s, d).select("id", x.most_significant_rank(C("e")).alias("rank")), f"WITH {T} SELECT id, {SQL_RANK} AS rank FROM t"),
    "x2_name_string": (lambda s, d: taxa(s, d).select("id", x.name_string(C("e"), C("authority")).alias("name"), x.name_string(C("e"), hybrid=C("hybrid") & (F.size("e") > 1)).alias("hybrid")), f"WITH {T} SELECT id, {SQL_NAME.format(h='false')} || ' ' || authority AS name, {SQL_NAME.format(h='hybrid')} AS hybrid FROM t"),
    "x3_epithets": (lambda s, d: parts(s, d).select("p_partkey", F.expr(RANK_SQL).alias("rank"), C("p_name").alias("e")).select("p_partkey", x.format_epithet(C("rank"), C("e")).alias("epithet"), x.level(C("rank")).alias("level"), x.is_primary(C("rank")).alias("primary")), f"SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'subsp. ' || p_name WHEN 2 THEN 'var. ' || p_name ELSE p_name END AS epithet, CASE p_size % 5 WHEN 0 THEN 8 WHEN 1 THEN 13 WHEN 2 THEN 14 WHEN 3 THEN 6 ELSE -1 END AS level, p_size % 5 = 0 AS \"primary\" FROM part"),
    "x4_primary_ranks": (lambda s, d: parts(s, d).select("p_partkey", F.expr(RANK_SQL).alias("rank")).select("p_partkey", x.primary_parent(C("rank")).alias("parent"), x.primary_child(C("rank")).alias("child")), "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'tribe' WHEN 1 THEN 'species' WHEN 2 THEN 'species' WHEN 3 THEN 'family' END AS parent, CASE p_size % 5 WHEN 0 THEN 'species' WHEN 3 THEN 'tribe' END AS child FROM part"),
    "x5_split_authority": (lambda s, d: taxa(s, d).select("id", x.split_authority(C("authority")).alias("a")).select("id", "a.*"), f"WITH {T} SELECT id, {BASE} AS basionym, CASE WHEN authority LIKE '%Miller%' THEN 'Miller, 2013' END AS combination FROM t"),
    "x6_parse_authority": (lambda s, d: taxa(s, d).select("id", x.parse_authority(x.split_authority(C("authority"))["basionym"]).alias("a")).select("id", "a.*"), f"WITH {T} SELECT id, CASE WHEN authority <> 'Miller, 2013' THEN 'Clement' END AS name, CASE WHEN authority <> 'Miller, 2013' THEN 1924 END AS year FROM t"),
    "x7_verbatim_authority": (lambda s, d: taxa(s, d).filter("species IS NOT NULL").select("id", x.verbatim_authority(F.concat_ws(" ", "genus", "species", "authority"), C("species")).alias("authority")), f"WITH {T} SELECT id, authority FROM t WHERE species IS NOT NULL"),
    "x8_show_authority": (lambda s, d: taxa(s, d).select("id", x.show_authority(F.when(C("hybrid"), "Clement"), F.lit("Miller")).alias("a")), f"WITH {T} SELECT id, CASE WHEN hybrid THEN '(Clement) Miller' ELSE 'Miller' END AS a FROM t"),
    "x9_dwc_round_trip": (dwc, f"WITH {T} SELECT id, genus, subgenus, species, subspecies, variety, authority, CASE WHEN species IS NULL THEN NULL WHEN id % 2 = 0 THEN 'dwc:speciesEpithet' ELSE 'dwc:Species' END AS element FROM t"),
    "x10_tagged_names": (tagged_names, f"WITH {T}, k AS (SELECT *, authority LIKE '%Miller%' AS m, CASE WHEN id % 5 = 0 THEN 1888 END AS y FROM t) SELECT id, coalesce(variety, subspecies, species, subgenus, genus) AS epithet, hybrid AND species IS NOT NULL AND coalesce(subspecies, variety) IS NULL AS hybrid, CASE WHEN id % 3 = 0 THEN 'Stated' WHEN m THEN 'Miller' END AS name, CASE WHEN id % 3 > 0 AND m THEN 2013 ELSE y END AS year, CASE WHEN authority LIKE '%Clement%' THEN 'Clement' END AS base_name, CASE WHEN authority LIKE '%Clement%' THEN 1924 END AS base_year FROM k"),
    "x9_dwc_xml": (lambda s, d: taxa(s, d).select("id", F.concat(F.lit("<t><genus>"), "genus", F.lit("</genus>"), F.coalesce(F.concat(F.lit("<specificEpithet>"), "species", F.lit("</specificEpithet>")), F.lit("")), F.lit("</t>")).alias("x")).select("id", "x", F.expr("xpath_string(x, 't/genus')").alias("genus"), F.expr("xpath_string(x, 't/specificEpithet')").alias("species")), f"WITH {T} SELECT id, '<t><genus>' || genus || '</genus>' || coalesce('<specificEpithet>' || species || '</specificEpithet>', '') || '</t>' AS x, genus, coalesce(species, '') AS species FROM t"),
    "x10_from_attributes": (lambda s, d: taxa(s, d).select("id", F.coalesce("species", F.lower(F.substring("genus", 1, 4))).alias("epithet"), x.name_string(C("e")).alias("name")), f"WITH {T} SELECT id, coalesce(species, lower(substr(genus, 1, 4))) AS epithet, {SQL_NAME.format(h='false')} AS name FROM t"),
    "e1_normalise": (cleaned, f"SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 'seven' WHEN p_name LIKE 'small %' THEN 'tiny' ELSE replace({CLEAN}, 'red', 'rubra') END AS value FROM part"),
    "e2_normal_spaces": (lambda s, d: parts(s, d).select("p_partkey", v.normal_spaces(F.expr(VALUE)).alias("value")), "SELECT p_partkey, p_name || ', ' || lower(p_type) || '(' || p_brand || '); x. ' || p_size AS value FROM part"),
    "e3_pattern_replace": (lambda s, d: parts(s, d).select("p_partkey", v.pattern_replace(C("p_name"), "red", "rot").alias("whole"), v.pattern_replace(C("p_name"), "red", "rot_$").alias("start"), v.pattern_replace(C("p_name"), "ring", "$_band").alias("last"), v.pattern_replace(C("p_name"), "e", "$_$").alias("any")), "SELECT p_partkey, p_name AS whole, regexp_replace(p_name, '^red', 'rot') AS start, regexp_replace(p_name, 'ring$', 'band') AS last, trim(regexp_replace(p_name, 'e', '')) AS \"any\" FROM part"),
    "e4_mojibake": (lambda s, d: table(s, d, "documents").select("doc_id", v.repair_mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")).alias("text")), "SELECT doc_id, text FROM documents"),
    "e8_segment_name": (lambda s, d: parts(s, d).select("p_partkey", x.segment_name(F.expr(SEG)).alias("n")).select("p_partkey", "n.*"), "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'Abies' WHEN 2 THEN 'Abies alba var.' ELSE '' END AS prefix, CASE p_size % 4 WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2) ELSE 'Abies' END AS epithet, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Mill.' WHEN 2 THEN '(L.) Mill.' ELSE 'L.' END AS authority FROM part"),
    "e19_clean_epithet": (lambda s, d: parts(s, d).select("p_partkey", x.clean_epithet(F.concat_ws("_", "p_name", "p_brand")).alias("e")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '_' || p_brand), '[^a-z]+', '-', 'g'), '^-+|-+$', '', 'g') AS e FROM part"),
    "c1_base29": (lambda s, d: table(s, d, "orders").select("o_orderkey", x.to_base29(C("o_orderkey") * 97).alias("code")).withColumn("back", x.from_base29(F.lower("code"))), f"WITH o AS (SELECT o_orderkey, o_orderkey * 97 AS n FROM orders) SELECT o_orderkey, coalesce(nullif(ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda k: substr('{x.BASE29}', ((n // power(29, k)::BIGINT) % 29 + 1)::INT, 1)), ''), '2'), ''), '2') AS code, n AS back FROM o"),
    "c9_format_epithet": (lambda s, d: parts(s, d).select("p_partkey", *(x.format_epithet(F.lit(k), C("p_name")).alias(k) for k in ("subGenus", "section", "form", "species"))), "SELECT p_partkey, '(' || p_name || ')' AS subGenus, '(sect. ' || p_name || ')' AS section, 'f. ' || p_name AS form, p_name AS species FROM part"),
    "c11_c12_matches": (lambda s, d: parts(s, d).select("p_partkey", x.matches(C("p_name"), F.lit("Red"), True, False).alias("ci"), x.matches(C("p_name"), F.lit("Red"), True, True).alias("cs"), x.matches(C("p_name"), F.lit("RED RING"), False, False).alias("eq")), "SELECT p_partkey, starts_with(lower(p_name), 'red') AS ci, starts_with(p_name, 'Red') AS cs, lower(p_name) = 'red ring' AS eq FROM part"),
}
