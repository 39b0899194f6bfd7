"""Queries on bibliographic records, made from orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as r
from ..operators import markup as mk
from ..operators import records as rec
from ..operators import tokens as tk
from ..session import table

#: Records in SQL that both engines read.
RECORDS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 THEN c_name END AS author, CASE WHEN o_orderkey % 7 > 2 THEN 'Doe, J' || (o_orderkey % 50) END AS author2,
CASE WHEN o_orderkey % 13 > 0 THEN CAST(year(o_orderdate) AS VARCHAR(10)) END AS year, 'On <i>' || lower(o_orderpriority) || '</i> ' || (o_orderkey % 300) AS title,
CASE WHEN o_orderkey % 3 = 0 THEN 'The Journal' END AS journal, CASE WHEN o_orderkey % 3 = 1 THEN 'The Press' END AS publisher, CASE WHEN o_orderkey % 5 = 1 THEN 'Berlin' END AS location,
CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 > 0 THEN 'Handbook' END AS volume_title, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS VARCHAR(10)) END AS volume, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR(10)) END AS issue,
CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 500 AS VARCHAR(10)) ELSE (o_orderkey % 500) || '-' || (o_orderkey % 500 + 7) END AS pagination,
CASE WHEN o_orderkey % 6 = 0 THEN '10.3897/x.' || (o_orderkey % 2000) END AS doi FROM {orders} o JOIN {customer} c ON c_custkey = o_custkey"""
R = "r AS (" + RECORDS.format(orders="orders", customer="customer") + ")"
FIELDS = ["author", "author2", "year", "title", "journal", "publisher", "location", "volume_title", "volume", "issue", "pagination", "doi"]


def records(s, d):
    return s.sql(RECORDS, orders=table(s, d, "orders"), customer=table(s, d, "customer"))


#: Raw values for the sanitisers, in SQL that both engines read.
RAW = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN ' 1999' WHEN 1 THEN 'MCMXCIX' WHEN 2 THEN '99' ELSE CAST(year(o_orderdate) AS VARCHAR(10)) END AS year,
CASE o_orderkey % 5 WHEN 0 THEN '0' || (o_orderkey % 90 + 1) WHEN 1 THEN 'E' || (o_orderkey % 9 + 1) WHEN 2 THEN (o_orderkey % 700 + 100) || '-' || (o_orderkey % 10) WHEN 3 THEN (o_orderkey % 9 + 1) || '–' || (o_orderkey % 9 + 3) ELSE 'vol' END AS volume,
CASE o_orderkey % 4 WHEN 0 THEN 'xii' WHEN 1 THEN '1-2-3' WHEN 2 THEN (o_orderkey % 900 + 100) || '-' || (o_orderkey % 100 + 10) ELSE CAST(o_orderkey % 300 + 1 AS VARCHAR(10)) END AS pages,
CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR(10)) WHEN 1 THEN substr(CAST(o_orderdate AS VARCHAR(40)), 1, 7) WHEN 2 THEN substr(CAST(o_orderdate AS VARCHAR(40)), 1, 10) ELSE 'soon' END AS day,
CASE o_orderkey % 3 WHEN 0 THEN 'http://dx.doi.org/10.3897/z.' || o_orderkey WHEN 1 THEN '10. 3897/' || o_orderkey ELSE 'doi:' || o_orderkey END AS doi,
CASE o_orderkey % 3 WHEN 0 THEN 'Part ' || (o_orderkey % 40) WHEN 1 THEN 'part xiv, 3' ELSE 'supplement' END AS part,
CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 50 + 5) || '-' || (o_orderkey % 50 + 17) || ', 300 pp.' WHEN 1 THEN '240 pages' ELSE 'p' || (o_orderkey % 80 + 2) END AS paging,
CASE o_orderkey % 3 WHEN 0 THEN 'Berlin: ' || o_orderpriority WHEN 1 THEN 'Press, ' || o_orderpriority ELSE 'Zoo' END AS jop FROM {orders}"""
W = "w AS (" + RAW.format(orders="orders") + ")"


def raw(s, d):
    return s.sql(RAW, orders=table(s, d, "orders"))


C = F.col


def authors():
    return F.filter(F.array("author", "author2"), lambda x: x.isNotNull())


SQL_AUTHORS = "list_filter([author, author2], lambda x: x IS NOT NULL)"


def sql_part(c: str, prefixes: str) -> str:
    t = f"lower(trim(regexp_replace(regexp_replace({c}, '[‐-―−]', '-', 'g'), '\\s+', ' ', 'g')))"
    one, two = f"'^([{prefixes}]?)0*([0-9]+)$'", f"'^([{prefixes}]?)0*([0-9]+)-0*([0-9]+)$'"
    a, b, p = (f"regexp_extract({t}, {two}, {k})" for k in (2, 3, 1))
    whole = f"(CASE WHEN length({b}) < length({a}) THEN substr({a}, 1, length({a}) - length({b})) || {b} ELSE {b} END)"
    return f"CASE WHEN regexp_matches({t}, {one}) THEN regexp_extract({t}, {one}, 1) || regexp_extract({t}, {one}, 2) WHEN regexp_matches({t}, {two}) THEN CASE WHEN {whole}::BIGINT > {a}::BIGINT THEN {p} || {a} || '-' || {whole} END END"


def missing(*groups: str) -> str:
    return ", ".join(f"CASE WHEN coalesce({g.replace(' or ', ', ')}) IS NULL THEN 'missing {g}' END" for g in groups)


def _errors(*parts: str) -> str:
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


BAD_YEAR = "CASE WHEN NOT regexp_full_match(year, '[12][0-9]{3}') THEN 'invalid year' END"


def extra(a: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL THEN 'unexpected {a}' END"


SQL_ERRORS = {
    "journal article": _errors(missing("author", "year", "title", "journal", "volume or issue", "pagination"), extra("publisher"), BAD_YEAR, "CASE WHEN NOT regexp_full_match(pagination, '[0-9]+(-[0-9]+)?') THEN 'invalid pagination' END"),
    "book chapter": _errors(missing("author", "year", "title", "volume_title", "pagination"), extra("journal"), BAD_YEAR, "CASE WHEN NOT regexp_full_match(pagination, '[0-9]+-[0-9]+') THEN 'invalid pagination' END"),
    "journal volume": _errors(missing("year", "journal", "volume or issue"), extra("pagination"), BAD_YEAR),
    "book": _errors(missing("author", "year", "title", "publisher or location"), extra("journal"), extra("volume_title"), BAD_YEAR, "CASE WHEN pagination LIKE '%-%' THEN 'a range of pages' END"),
    "url": _errors(missing("title", "doi")),
}
SQL_CLASS = "CASE " + " ".join(f"WHEN len({e}) = 0 THEN '{t}'" for t, e in SQL_ERRORS.items()) + " END"
KIND = "CASE id % 6 WHEN 0 THEN 'journal article' WHEN 1 THEN 'book chapter' WHEN 2 THEN 'journal volume' WHEN 3 THEN 'book' WHEN 4 THEN 'url' ELSE 'map' END"
XML = "'<bibRef>' || coalesce('<author>' || author || '</author>', '') || coalesce('<author>' || author2 || '</author>', '') || coalesce('<year>' || year || '</year>', '') || '<title>' || replace(replace(title, '<', '&lt;'), '>', '&gt;') || '</title>' || coalesce('<journal>' || journal || '</journal>', '') || coalesce('<volume>' || volume || '</volume>', '') || coalesce('<pagination>' || pagination || '</pagination>', '') || '</bibRef>'"


def xml(s, d):
    return records(s, d).select("id", r.to_xml([(n, C(n)) for n in ("year", "title", "journal", "volume", "pagination")], authors()).alias("xml"))


def merged(s, d):
    by_doi = rec.merge(records(s, d), C("doi"), "id", FIELDS)
    return rec.merge(by_doi, F.when(r.light_hash(C("title")) != "", r.light_hash(C("title"))), "id", FIELDS)


def sql_merge(src: str, by: str) -> str:
    first = ", ".join(f"arg_min({f}, id) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in FIELDS)
    return f"SELECT min(id) AS id, {first} FROM {src} GROUP BY coalesce({by}, 'no' || id)"


HASH = "regexp_replace(lower(regexp_replace(title, '<[^>]+>', '', 'g')), '[^a-z0-9]', '', 'g')"
FINDER = "to_json(named_struct('authors', array(array(substring_index(author, '#', -1), substring_index(author, '#', 1))), 'publishedIn', concat(journal, ' (B)'), 'publicationDate', concat(year, '-02'), 'title', title))"


def finder(s, d):
    """Finder answers as JSON, read with a schema: names turned round, dates completed, series split off; answers without author, title or year left out."""
    j = records(s, d).select("id", F.expr(FINDER).alias("j")).select("id", F.from_json("j", "authors array<array<string>>, publishedIn string, publicationDate string, title string").alias("x"))
    name = F.transform("x.authors", lambda a: F.concat_ws(", ", a[1], a[0]))
    ok = C("x.title").isNotNull() & C("x.authors")[0][0].isNotNull() & C("x.publicationDate").rlike("^[12][0-9]{3}")
    return j.filter(ok).select("id", F.array_join(name, " & ").alias("author"), r.period_end(C("x.publicationDate")).alias("date"), F.regexp_extract("x.publishedIn", r"^(.*) \((.*)\)$", 1).alias("journal"), F.regexp_extract("x.publishedIn", r"^(.*) \((.*)\)$", 2).alias("series"))


#: Records as XML in Spark's SQL: persons as elements, repeated or an attribute, old names, typed parts.
GENERIC_XML = """concat('<bibRef', CASE WHEN id % 4 = 0 THEN concat(' author="', concat_ws(' &amp; ', author, author2), '"') ELSE '' END, '>',
CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('<author repeatedAuthors="', concat_ws(' &amp; ', author, author2), '"/>') ELSE concat(coalesce(concat('<author affiliation="Museum">', author, '</author>'), ''), coalesce(concat('<author>', author2, '</author>'), '')) END,
'<title>', replace(replace(title, '<', '&lt;'), '>', '&gt;'), '</title>', coalesce(concat('<year>', year, '</year>'), ''), coalesce(CASE WHEN id % 2 = 0 THEN concat('<pageData>', pagination, '</pageData>') ELSE concat('<pagination>', pagination, '</pagination>') END, ''),
coalesce(concat('<hostTitle>', volume_title, '</hostTitle>'), ''), coalesce(concat('<part>', volume, '</part>'), ''), coalesce(concat('<part type="issue">', issue, '</part>'), ''),
'<journalOrPublisher>', CASE WHEN id % 3 = 0 THEN 'The Journal' ELSE 'Berlin: The Press' END, '</journalOrPublisher>', coalesce(concat('<ID type="DOI">', doi, '</ID>'), ''), '</bibRef>')"""
#: What each of these records holds, told from the columns.
HELD = f"""WITH {R}, g AS (SELECT *, coalesce(volume, issue) AS num, CASE WHEN id % 3 = 0 THEN 'The Journal' ELSE 'Berlin: The Press' END AS jop FROM r)
SELECT id, concat_ws(' & ', author, author2) AS authors, CASE WHEN id % 4 > 1 AND author IS NOT NULL THEN 'Museum' END AS affiliation, title, year, pagination, volume_title AS volumetitle, volume, issue, doi,
CASE WHEN num IS NOT NULL THEN jop END AS journal, CASE WHEN num IS NULL THEN CASE WHEN id % 3 = 0 THEN 'The Journal' ELSE 'The Press' END END AS publisher, CASE WHEN num IS NULL AND id % 3 > 0 THEN 'Berlin' END AS location FROM g"""


def generic(s, d):
    return mk.from_generic(records(s, d).select("id", F.expr(GENERIC_XML).alias("xml")), "xml")


def held(rows):
    """The columns of a record."""
    x = C("record")
    return rows.select("id", F.array_join(F.transform(x["authors"], lambda a: a["name"]), " & ").alias("authors"), F.get(x["authors"], F.lit(0))["details"]["affiliation"].alias("affiliation"), *(x["fields"][n].alias(n.lower()) for n in ("title", "year", "pagination", "volumeTitle", "volume", "issue", "journal", "publisher", "location")), x["ids"]["DOI"].alias("doi"))


def through_attributes(s, d):
    m = generic(s, d).select("id", mk.to_attributes(C("record"), "bib:", F.create_map(*map(F.lit, ("bib:old", "1", "own", "2")))).alias("m"))
    return held(mk.from_attributes(m.filter("m['own'] = '2' AND m['bib:old'] IS NULL"), "m", "bib:"))


def through_mods(s, d):
    return held(mk.from_mods(generic(s, d).select("id", mk.to_mods(C("record")).alias("mods")), "mods"))


def told(s, d):
    a = generic(s, d).select("id", mk.document_attributes(C("record")).alias("a"))
    return a.select("id", *(C("a")[n].alias(n.lower().replace("-", "_")) for n in ("docAuthor", "docTitle", "docDate", "docOrigin", "pageNumber", "lastPageNumber", "ID-DOI")))


RULES = '<types><type name="url" strictness="9"><require any="doi"/></type></types>'

QUERIES = {
    "b1_from_xml": (lambda s, d: xml(s, d).select("id", F.xpath("xml", F.lit("bibRef/author/text()")).alias("a"), F.xpath_string("xml", F.lit("bibRef/title")).alias("title"), F.xpath_string("xml", F.lit("bibRef/pagination")).alias("pages")).select("id", F.array_join("a", " & ").alias("authors"), "title", "pages"), f"WITH {R} SELECT id, array_to_string({SQL_AUTHORS}, ' & ') AS authors, title, coalesce(pagination, '') AS pages FROM r"),
    "b1_generic_xml": (lambda s, d: held(generic(s, d)), HELD),
    "b3_attributes_round_trip": (through_attributes, HELD),
    "b4_b6_mods_round_trip": (through_mods, HELD),
    "b24_told_of_documents": (told, f"WITH h AS ({HELD}) SELECT id, CASE WHEN authors <> '' THEN authors END AS docauthor, title AS doctitle, year AS docdate, CASE WHEN pagination IS NOT NULL OR volumetitle IS NOT NULL THEN coalesce(journal || ' ' || coalesce(volume, issue), volumetitle, location || ': ' || publisher, publisher) END AS docorigin, split_part(pagination, '-', 1) AS pagenumber, CASE WHEN pagination LIKE '%-%' THEN split_part(pagination, '-', 2) END AS lastpagenumber, doi AS id_doi FROM h"),
    "b26_clean_mods": (lambda s, d: records(s, d).select("id", mk.clean_mods(F.concat(F.lit('<mods:mods><page n="'), "id", F.lit('"><mods:title>A <b>'), F.coalesce("year", F.lit("")), F.lit("</b> B</mods:title></page></mods:mods>"))).alias("mods")), f"WITH {R} SELECT id, '<mods:mods xmlns:mods=\"{mk.MODS}\"><mods:title>A ' || coalesce(year, '') || ' B</mods:title></mods:mods>' AS mods FROM r"),
    "b2_journal_or_publisher": (lambda s, d: raw(s, d).select("id", r.journal_or_publisher(C("jop"), C("id") % 4 == 0).alias("x")).select("id", "x.*"), f"WITH {W} SELECT id, CASE WHEN id % 4 = 0 THEN jop END AS journal, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 3 = 0 THEN split_part(jop, ': ', 2) WHEN id % 3 = 1 THEN 'Press' ELSE jop END AS publisher, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 3 = 0 THEN 'Berlin' WHEN id % 3 = 1 THEN split_part(jop, ', ', 2) END AS location FROM w"),
    "b3_prefixed_attributes": (lambda s, d: records(s, d).select("id", rec.with_prefix(F.create_map(*(x for n in ("year", "journal", "volume") for x in (F.lit(n), C(n)))), "bib-").alias("m")).select("id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), F.element_at(rec.without_prefix(C("m"), "bib-"), "journal").alias("journal")), f"WITH {R} SELECT id, array_to_string(list_filter([CASE WHEN journal IS NOT NULL THEN 'bib-journal' END, CASE WHEN volume IS NOT NULL THEN 'bib-volume' END, CASE WHEN year IS NOT NULL THEN 'bib-year' END], lambda x: x IS NOT NULL), ',') AS keys, journal FROM r"),
    "b4_mods_pages": (lambda s, d: records(s, d).select("id", F.concat(F.lit("<mods><part><extent><start>"), F.split("pagination", "-")[0], F.lit("</start><end>"), F.element_at(F.split("pagination", "-"), -1), F.lit("</end></extent></part></mods>")).alias("m")).select("id", F.expr("xpath_int(m, 'mods/part/extent/start')").alias("first"), F.expr("xpath_int(m, 'mods/part/extent/end')").alias("last")), f"WITH {R} SELECT id, split_part(pagination, '-', 1)::INT AS first, list_extract(str_split(pagination, '-'), -1)::INT AS last FROM r"),
    "b5_to_xml": (xml, f"WITH {R} SELECT id, {XML} AS xml FROM r"),
    "b6_origin_string": (lambda s, d: records(s, d).select("id", F.concat_ws(", ", F.concat_ws(" ", "journal", "volume"), "volume_title", F.concat_ws(": ", "location", "publisher")).alias("origin")), f"WITH {R} SELECT id, concat_ws(', ', concat_ws(' ', journal, volume), volume_title, concat_ws(': ', location, publisher)) AS origin FROM r"),
    "b7_reference_string": (lambda s, d: records(s, d).select("id", r.reference_string(F.when(F.size(authors()) > 0, r.persons(authors(), 5, 200)), C("year"), C("title"), F.coalesce(F.concat_ws(" ", "journal", "volume"), C("publisher")), C("pagination"), C("doi")).alias("ref")), f"WITH {R} SELECT id, coalesce(coalesce(author || ' & ' || author2, author, author2) || ' ', '') || coalesce('(' || year || '): ', '') || title || '. ' || concat_ws(' ', journal, volume) || coalesce(': ' || pagination, '') || coalesce('. https://doi.org/' || doi, '') AS ref FROM r"),
    "b8_styles": (lambda s, d: records(s, d).select("id", r.in_style("SHORT").alias("short"), r.in_style("Journal").alias("journal")), f"WITH {R} SELECT id, concat_ws(' ', author, year) AS short, concat_ws(' ', journal, volume || ':', pagination) AS journal FROM r"),
    "b15_loaded_rules": (lambda s, d: records(s, d).select("id", rec.classify(rec.load_types(RULES, rec.TYPES, replace=True)).alias("type")), f"WITH {R} SELECT id, {SQL_CLASS.replace('CASE ', 'CASE WHEN doi IS NOT NULL THEN ' + chr(39) + 'url' + chr(39) + ' ', 1)} AS type FROM r"),
    "b9_sanitise": (lambda s, d: raw(s, d).select("id", r.year(C("year")).alias("year"), r.part(C("volume")).alias("volume"), r.pagination(C("pages")).alias("pages"), r.period_end(C("day")).alias("day")), f"WITH {W} SELECT id, CASE id % 4 WHEN 0 THEN '1999' WHEN 1 THEN '1999' WHEN 2 THEN NULL ELSE year END AS year, {sql_part('volume', 'es')} AS volume, CASE WHEN pages = 'xii' THEN '12' ELSE {sql_part('pages', 'e')} END AS pages, CASE id % 4 WHEN 0 THEN day || '-12-31' WHEN 1 THEN last_day((day || '-01')::DATE)::VARCHAR WHEN 2 THEN day END AS day FROM w"),
    "b10_clean_string": (lambda s, d: table(s, d, "documents").select("doc_id", r.clean_string(F.concat(F.lit("  — "), "text")).alias("clean")), "SELECT doc_id, trim(regexp_replace(regexp_replace('  — ' || text, '[‐-―−]', '-', 'g'), '[  -​　\\s\\x0B]+', ' ', 'g')) AS clean FROM documents"),
    "b11_pagination_type": (lambda s, d: raw(s, d).select("id", r.first_pages(C("paging")).alias("pages")).select("id", "pages", r.upgraded_type(F.when(C("id") % 2 == 0, "book").otherwise("journal volume"), F.coalesce("pages", F.lit(""))).alias("type")), f"WITH {W} SELECT id, CASE id % 3 WHEN 0 THEN split_part(paging, ',', 1) WHEN 2 THEN substr(paging, 2) END AS pages, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'book chapter' ELSE 'journal article' END ELSE CASE WHEN id % 2 = 0 THEN 'book' ELSE 'journal volume' END END AS type FROM w"),
    "b12_b13_errors": (lambda s, d: records(s, d).select("id", F.array_join(rec.check(F.expr(KIND)), "; ").alias("errors")), f"WITH {R} SELECT id, array_to_string(CASE {KIND} " + " ".join(f"WHEN '{t}' THEN {e}" for t, e in SQL_ERRORS.items()) + " ELSE ['unknown type'] END, '; ') AS errors FROM r"),
    "b14_classify": (lambda s, d: records(s, d).select("id", rec.classify().alias("type")), f"WITH {R} SELECT id, {SQL_CLASS} AS type FROM r"),
    "b16_doi": (lambda s, d: raw(s, d).select("id", r.doi(C("doi")).alias("doi")), f"WITH {W} SELECT id, CASE id % 3 WHEN 0 THEN '10.3897/z.' || id WHEN 1 THEN '10.3897/' || id END AS doi FROM w"),
    "b17_search_origin": (lambda s, d: records(s, d).select("id", r.origin(*(C(n) for n in ("journal", "volume", "issue", "volume_title", "location", "publisher"))).alias("origin")), f"WITH {R} SELECT id, coalesce(CASE WHEN journal IS NOT NULL THEN concat_ws(' ', journal, coalesce(volume, issue)) END, volume_title, location || ': ' || publisher, location, publisher) AS origin FROM r"),
    "b18_merge_duplicates": (merged, f"WITH {R}, a AS ({sql_merge('r', 'doi')}) {sql_merge('a', HASH)}"),
    "b19_light_hash": (lambda s, d: records(s, d).select("id", r.light_hash(C("title")).alias("hash")), f"WITH {R} SELECT id, {HASH} AS hash FROM r"),
    "b20_s17_finder_results": (finder, f"WITH {R} SELECT id, split_part(author, '#', 1) || ', ' || split_part(author, '#', 2) AS author, last_day((year || '-02-01')::DATE)::VARCHAR AS date, journal, CASE WHEN journal IS NOT NULL THEN 'B' END AS series FROM r WHERE author IS NOT NULL AND year IS NOT NULL"),
    "b21_equality": (lambda s, d: records(s, d).alias("a").join(records(s, d).withColumn("id", C("id") + 2000).alias("b"), "id").select("id", F.struct(*(C(f"a.{f}") for f in FIELDS)).eqNullSafe(F.struct(*(C(f"b.{f}") for f in FIELDS))).alias("same"), C("a.doi").eqNullSafe(C("b.doi")).alias("same_doi")), f"WITH {R} SELECT a.id, ({', '.join('a.' + f for f in FIELDS)}) IS NOT DISTINCT FROM ({', '.join('b.' + f for f in FIELDS)}) AS same, a.doi IS NOT DISTINCT FROM b.doi AS same_doi FROM r a JOIN r b ON a.id = b.id + 2000"),
    "b22_person_lists": (lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("n")).select("c_nationkey", r.persons(F.slice("n", 1, 3), 5, 100).alias("three"), r.persons(C("n"), 4, 60).alias("some")), "WITH n AS (SELECT c_nationkey, list(c_name ORDER BY c_name) AS n FROM customer GROUP BY 1) SELECT c_nationkey, CASE least(3, len(n)) WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' & ' || n[2] ELSE n[1] || ', ' || n[2] || ' & ' || n[3] END AS three, CASE len(n) WHEN 1 THEN n[1] WHEN 2 THEN n[1] || ' & ' || n[2] WHEN 3 THEN n[1] || ', ' || n[2] || ' & ' || n[3] ELSE n[1] || ', ' || n[2] || ', ' || n[3] || ' et al.' END AS some FROM n"),
    "b23_part_number": (lambda s, d: raw(s, d).select("id", r.part_number(C("part")).alias("n")), f"WITH {W} SELECT id, CASE id % 3 WHEN 0 THEN id % 40 WHEN 1 THEN 14 ELSE 0 END::INT AS n FROM w"),
    "b24_document_attributes": (lambda s, d: records(s, d).select("id", F.array_join(authors(), " & ").alias("docAuthor"), C("title").alias("docTitle"), C("year").alias("docDate"), F.split("pagination", "-")[0].alias("pageNumber"), F.element_at(F.split("pagination", "-"), -1).alias("lastPageNumber")), f"WITH {R} SELECT id, array_to_string({SQL_AUTHORS}, ' & ') AS docAuthor, title AS docTitle, year AS docDate, split_part(pagination, '-', 1) AS pageNumber, list_extract(str_split(pagination, '-'), -1) AS lastPageNumber FROM r"),
    "b25_first_source": (lambda s, d: rec.first_source(records(s, d).select("id", (C("id") % 900).alias("doc"), F.when(C("doi").isNotNull(), 1).when(C("journal").isNotNull(), 2).otherwise(3).alias("priority")), "doc", "priority"), f"WITH {R}, p AS (SELECT id, id % 900 AS doc, CASE WHEN doi IS NOT NULL THEN 1 WHEN journal IS NOT NULL THEN 2 ELSE 3 END AS priority FROM r) SELECT * FROM p QUALIFY rank() OVER (PARTITION BY doc ORDER BY priority) = 1"),
    "b26_without_foreign": (lambda s, d: tk.window_spans(table(s, d, "documents"), r"^\p{Lu}", 1).withColumn("type", F.when(C("start") % 2 == 0, "mods").otherwise("name")).filter("type = 'mods'").groupBy("doc_id").count().withColumnRenamed("count", "n"), r"WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}]+|[0-9]+|[^\s\p{L}\p{M}0-9]') AS a FROM documents), k AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS tok FROM t) SELECT doc_id, count(*) AS n FROM k WHERE pos % 2 = 0 AND regexp_matches(tok, '^\p{Lu}') GROUP BY 1"),
    "n10_author_match": (lambda s, d: records(s, d).filter("author2 IS NOT NULL").select("id", F.array_join(F.array_sort(F.split(F.trim(F.regexp_replace(F.lower(tk.fold_accents(F.concat_ws(" ", "author2", F.lit("É")))), "[^a-z]+", " ")), " ")), " ").alias("key")), f"WITH {R} SELECT id, 'doe e j' AS key FROM r WHERE author2 IS NOT NULL"),
}
