"""Reference records in and out of XML, MODS and attribute maps; names in attributes.

A record is struct(authors array<struct(name, details map)>, editors array, fields map, ids map, type). Each document is
parsed once, by from_xml with a schema; a document that isn't XML gives a record without anything in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs as r
from ..functions import taxa as tx

#: The attributes of a record besides persons, the names older documents have for two of them, and the MODS name space.
FIELDS = ("title", "year", "pubDate", "accessDate", "journal", "seriesInJournal", "publisher", "location", "pagination", "volume", "issue", "numero", "volumeTitle", "bookContentInfo", "publicationUrl")
OLD = {"pagination": "pageData", "volumeTitle": "hostTitle"}
MODS = "http://www.loc.gov/mods/v3"
NUMBERS = ("volume", "issue", "numero")
TYPED = "array<struct<_VALUE string, _type string>>"
GENERIC = ", ".join([f"{n} array<string>" for n in (*FIELDS, *OLD.values(), "editor", "journalOrPublisher")] + [f"_{n} string" for n in (*FIELDS, "author", "editor", "journalOrPublisher", "type")] + [f"{n} {TYPED}" for n in ("part", "ID")])
PERSON = f"array<struct<namePart array<string>, role array<struct<roleTerm array<string>>>, affiliation array<string>, nameIdentifier {TYPED}>>"
ORIGIN = f"struct<publisher array<string>, place array<struct<placeTerm array<string>>>, dateIssued array<string>, dateOther {TYPED}, dateCaptured array<string>>"
HOST = f"struct<_type string, titleInfo array<struct<title array<string>>>, name {PERSON}, part array<struct<detail array<struct<_type string, number array<string>, title array<string>>>, extent array<struct<_unit string, start string, end string>>, date array<string>>>>"
MODS_SCHEMA = f"titleInfo array<struct<title array<string>>>, name {PERSON}, originInfo array<{ORIGIN}>, relatedItem array<{HOST}>, location array<struct<url array<string>>>, identifier {TYPED}, classification array<string>, note array<string>"
NOTHING = "map<string, string>"
NAMED = "array<struct<_VALUE: string, _type: string>>"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _list(c: Column) -> Column:
    """Never null, without nulls and blanks; texts cleaned."""
    return F.filter(F.transform(F.coalesce(c, _none("array<string>"), F.array().cast("array<string>")), r.clean_string), lambda x: F.length(x) > 0)


def _first(c: Column) -> Column:
    return F.try_element_at(_list(c), F.lit(1))


def _people(c: Column) -> Column:
    return F.split(c, r"\s*&\s*")


def _map(entries: list[tuple[Column | str, Column]]) -> Column:
    """Map of the entries whose value isn't null or blank."""
    all_ = F.map_from_arrays(F.array(*(F.lit(k) if isinstance(k, str) else k for k, _ in entries)), F.array(*(F.trim(v) for _, v in entries)))
    return F.map_filter(all_, lambda _, v: F.length(v) > 0)


def _ids(c: Column) -> Column:
    """Identifiers by type, the first of each; those without a type are left out."""
    typed = F.filter(F.coalesce(c, F.array().cast(NAMED)), lambda m: m["_type"].isNotNull() & m["_VALUE"].isNotNull())
    pairs = F.transform(typed, lambda m: F.struct(m["_type"].alias("key"), F.trim(m["_VALUE"]).alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key: string, value: string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["key"] == p["key"]), a).otherwise(F.array_append(a, p)))
    return F.map_from_entries(first)


def _author(name: Column, details: Column) -> Column:
    return F.struct(name.alias("name"), details.alias("details"))


def _bare(names: Column) -> Column:
    return F.transform(names, lambda n: _author(n, F.create_map().cast(NOTHING)))


def _with_record(rows: DataFrame, to: str, authors: Column, editors: Column, fields: Column, ids: Column, kind: Column) -> DataFrame:
    """rows with a record; its parts are columns first, so that what reads a field doesn't compute it anew for each use.

    The record comes out of an explode of one element: filters on it stay above, while pushed
    down they would repeat the whole reading of the document for each use of a field.
    """
    parts = {"authors": authors, "editors": editors, "fields": fields, "ids": ids, "type": F.when(F.length(kind) > 0, kind)}
    rows = rows.withColumns({f"__record_{k}": c for k, c in parts.items()})
    return rows.withColumn(to, F.explode(F.array(F.struct(*(F.col(f"__record_{k}").alias(k) for k in parts))))).drop(*(f"__record_{k}" for k in parts))


def from_generic(rows: DataFrame, xml: str, to: str = "record", details: tuple[str, ...] = ("affiliation", "ORCID")) -> DataFrame:
    """rows with the record of an XML column.

    An element counts before an older name's, that before the root's attribute. Persons in an
    attribute, or in an element's repeatedAuthors, are joined by &; an author's attributes
    named in details are kept. Parts go by their type, volume if none is stated.
    journalOrPublisher is a journal if there is a part, else a publisher, maybe with a place.
    The type is the root's; records.classify finds one where it is null.
    """
    x = F.col("__x")
    texts = {n: _list(x[n]) for n in (*FIELDS, *OLD.values(), "editor", "journalOrPublisher")}
    value = {n: F.coalesce(F.try_element_at(texts[n], F.lit(1)), *([F.try_element_at(texts[OLD[n]], F.lit(1))] if n in OLD else []), r.clean_string(x[f"_{n}"])) for n in FIELDS}
    part = lambda n: F.try_element_at(F.filter(x["part"], lambda m: F.coalesce(m["_type"], F.lit("volume")) == n), F.lit(-1))
    for n in NUMBERS:
        value[n] = F.coalesce(r.clean_string(part(n)["_VALUE"]), value[n])
    two = r.journal_or_publisher(F.coalesce(F.try_element_at(texts["journalOrPublisher"], F.lit(1)), x["_journalOrPublisher"]), F.coalesce(*(value[n] for n in NUMBERS)).isNotNull())
    value |= {n: F.coalesce(value[n], two[n]) for n in ("journal", "publisher", "location")}
    own = lambda m: F.array(_author(r.clean_string(m["_VALUE"]), _map([(k, m[f"_{k}"]) for k in details])))
    named = F.filter(x["author"], lambda m: F.coalesce(m["_repeatedAuthors"], m["_VALUE"]).isNotNull())
    each = F.flatten(F.transform(named, lambda m: F.when(m["_repeatedAuthors"].isNotNull(), _bare(_list(_people(m["_repeatedAuthors"])))).otherwise(own(m))))
    authors = F.when(F.size(each) > 0, each).otherwise(_bare(_list(_people(x["_author"]))))
    editors = F.when(F.size(texts["editor"]) > 0, texts["editor"]).otherwise(_list(_people(x["_editor"])))
    schema = f"{GENERIC}, author array<struct<{', '.join(f'_{k} string' for k in ('VALUE', 'repeatedAuthors', *details))}>>"
    parsed = rows.withColumn("__x", F.from_xml(xml, F.lit(schema)))
    return _with_record(parsed, to, authors, editors, _map(list(value.items())), _ids(x["ID"]), x["_type"]).drop("__x")


def to_attributes(record: Column, prefix: str, existing: Column | None = None, details: bool = True) -> Column:
    """A record as a map with prefixed keys: persons joined by " & ", an author detail by " &&& ", at the author's place. Prefixed keys of existing are dropped, others stay."""
    authors, kept = record["authors"], F.create_map().cast(NOTHING) if existing is None else F.map_filter(existing, lambda k, _: ~k.startswith(prefix))
    keys = F.array_distinct(F.flatten(F.transform(authors, lambda a: F.map_keys(a["details"])))) if details else F.array().cast("array<string>")
    told = F.map_from_arrays(F.transform(keys, lambda k: F.concat(F.lit("author-"), k)), F.transform(keys, lambda k: F.array_join(F.transform(authors, lambda a: F.coalesce(F.try_element_at(a["details"], k), F.lit(""))), " &&& ")))
    people = _map([("author", F.array_join(F.transform(authors, lambda a: a["name"]), " & ")), ("editor", F.array_join(record["editors"], " & ")), ("type", record["type"])])
    whole = F.map_concat(record["fields"], F.transform_keys(record["ids"], lambda k, _: F.concat(F.lit("ID-"), k)), people, told)
    return F.map_concat(kept, F.transform_keys(whole, lambda k, _: F.concat(F.lit(prefix), k)))


def from_attributes(rows: DataFrame, attributes: str, prefix: str, to: str = "record") -> DataFrame:
    """rows with the record that to_attributes wrote to a map column. part is the first number not given; journalOrPublisher is resolved as in XML."""
    ours = F.map_filter(attributes, lambda k, v: k.startswith(prefix) & (F.length(F.trim(v)) > 0))
    rows = rows.withColumn("__m", F.transform_keys(ours, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k))))
    m = F.col("__m")
    get = lambda n: F.trim(F.try_element_at(m, F.lit(n)))
    value = {n: get(n) for n in FIELDS}
    for k, n in enumerate(NUMBERS):
        taken = [get(p).isNotNull() for p in NUMBERS[:k]]
        free = get("part") if not taken else F.when(taken[0] if k == 1 else taken[0] & taken[1], get("part"))
        value[n] = F.coalesce(get(n), free)
    two = r.journal_or_publisher(get("journalOrPublisher"), F.coalesce(*(value[n] for n in (*NUMBERS, "seriesInJournal"))).isNotNull())
    value |= {n: F.coalesce(value[n], two[n]) for n in ("journal", "publisher", "location")}
    told = F.filter(F.map_entries(m), lambda e: e["key"].startswith("author-"))
    rows = rows.withColumn("__told", F.transform(told, lambda e: F.struct(F.substring(e["key"], F.lit(8), F.length(e["key"])).alias("key"), F.split(e["value"], r"\s*&&&\s*").alias("each"))))
    pieces = F.col("__told")
    at = lambda i: F.map_from_entries(F.filter(F.transform(pieces, lambda p: F.struct(p["key"].alias("key"), F.get(p["each"], i).alias("value"))), lambda e: F.length(e["value"]) > 0))
    authors = F.transform(_list(_people(get("author"))), lambda n, i: _author(n, at(i)))
    ids = F.transform_keys(F.map_filter(m, lambda k, _: k.startswith("ID-")), lambda k, _: F.substring(k, F.lit(4), F.length(k)))
    return _with_record(rows, to, authors, _list(_people(get("editor"))), _map(list(value.items())), ids, get("type")).drop("__m", "__told")


def _tag(name: str, inside: Column, attributes: str = "") -> Column:
    """An element of what is inside, nothing for null and empty."""
    return F.coalesce(F.when(F.length(inside) > 0, F.concat(F.lit(f"<mods:{name}{attributes}>"), inside, F.lit(f"</mods:{name}>"))), F.lit(""))


def to_mods(record: Column) -> Column:
    """A record as MODS; our own template. The host is a journal, else the volume, and bears numbers, pages, year and editors; a book has none but its own title and origin."""
    get = lambda n: r.xml_escape(F.try_element_at(record["fields"], F.lit(n)))
    name = lambda n, role, more=None: F.concat(F.lit("<mods:name>"), _tag("namePart", r.xml_escape(n)), _tag("role", _tag("roleTerm", F.lit(role))), *([more] if more is not None else []), F.lit("</mods:name>"))
    details = lambda a: F.concat(_tag("affiliation", r.xml_escape(F.try_element_at(a["details"], F.lit("affiliation")))), F.array_join(F.transform(F.filter(F.map_entries(a["details"]), lambda e: e["key"] != "affiliation"), lambda e: F.concat(F.lit('<mods:nameIdentifier type="'), r.xml_escape(e["key"]), F.lit('">'), r.xml_escape(e["value"]), F.lit("</mods:nameIdentifier>"))), ""))
    detail = lambda kind, inside, tag="number": _tag("detail", _tag(tag, inside), f' type="{kind}"')
    pages = F.split(get("pagination"), "-")
    extent = _tag("extent", F.concat(_tag("start", pages[0]), _tag("end", F.element_at(pages, -1))), ' unit="page"')
    part = _tag("part", F.concat(*(detail(n, get(n)) for n in NUMBERS), detail("series", get("seriesInJournal"), "title"), detail("title", F.when(get("journal").isNotNull(), get("volumeTitle")), "title"), detail("pubDate", get("pubDate")), F.coalesce(extent, F.lit("")), _tag("date", get("year"))))
    host = _tag("relatedItem", F.concat(_tag("titleInfo", _tag("title", F.coalesce(get("journal"), get("volumeTitle")))), F.array_join(F.transform(record["editors"], lambda e: name(e, "Editor")), ""), part), ' type="host"')
    issued = F.coalesce(get("journal"), get("volumeTitle"), get("pagination"), *(get(n) for n in NUMBERS)).isNull()
    born = F.concat(_tag("publisher", get("publisher")), _tag("place", _tag("placeTerm", get("location"))), _tag("dateIssued", F.when(issued, get("year"))), _tag("dateOther", F.when(issued, get("pubDate")), ' type="pubDate"'), _tag("dateCaptured", get("accessDate")))
    ids = F.array_join(F.transform(F.map_entries(record["ids"]), lambda e: F.concat(F.lit('<mods:identifier type="'), r.xml_escape(e["key"]), F.lit('">'), r.xml_escape(e["value"]), F.lit("</mods:identifier>"))), "")
    return F.concat(
        F.lit(f'<mods:mods xmlns:mods="{MODS}">'), _tag("titleInfo", _tag("title", get("title"))), F.array_join(F.transform(record["authors"], lambda a: name(a["name"], "Author", details(a))), ""),
        _tag("classification", r.xml_escape(record["type"])), F.when(issued & (F.size(record["editors"]) == 0), "").otherwise(host), _tag("originInfo", born),
        _tag("location", _tag("url", get("publicationUrl"))), _tag("note", get("bookContentInfo")), ids, F.lit("</mods:mods>"),
    )


def from_mods(rows: DataFrame, xml: str, to: str = "record") -> DataFrame:
    """rows with the record of a MODS column: the document's first title, its authors, the first origin and host.

    The host's title is a journal's if the type or a number or series says so, else a
    volume's. First and last page are one range. An affiliation and typed name identifiers
    are details of an author. Name spaces don't matter.
    """
    x = F.col("__x")
    none = F.array().cast("array<string>")
    has_role = lambda p, role: F.exists(F.coalesce(p["role"], _none("array<struct<roleTerm: array<string>>>")), lambda q: F.exists(q["roleTerm"], lambda t: F.trim(t) == role))
    people = lambda c, role: F.filter(c, lambda p: F.coalesce(has_role(p, role), F.lit(False)) & (F.size(_list(p["namePart"])) > 0))
    title = lambda t: _first(F.flatten(F.transform(t, lambda i: F.coalesce(i["title"], none))))
    host = F.try_element_at(F.filter(x["relatedItem"], lambda i: i["_type"] == "host"), F.lit(1))
    origin = F.try_element_at(x["originInfo"], F.lit(1))
    part = F.try_element_at(host["part"], F.lit(1))
    detail = lambda kind, tag="number": _first(F.flatten(F.transform(F.filter(part["detail"], lambda q: q["_type"] == kind), lambda q: F.coalesce(q[tag], none))))
    extent = F.try_element_at(F.filter(part["extent"], lambda e: e["_unit"] == "page"), F.lit(1))
    first, last = F.trim(extent["start"]), F.trim(extent["end"])
    numbers = {n: detail(n) for n in NUMBERS} | {"seriesInJournal": detail("series", "title")}
    kind = F.lower(F.trim(F.try_element_at(x["classification"], F.lit(1))))
    journal = F.coalesce(kind.startswith("journal"), F.lit(False)) | F.coalesce(*numbers.values()).isNotNull()
    dated = F.try_element_at(F.filter(origin["dateOther"], lambda m: m["_type"] == "pubDate"), F.lit(1))
    value = numbers | {
        "title": F.coalesce(title(x["titleInfo"]), title(host["titleInfo"])), "year": F.coalesce(_first(part["date"]), _first(origin["dateIssued"])),
        "pubDate": F.coalesce(detail("pubDate"), dated["_VALUE"]), "accessDate": _first(origin["dateCaptured"]), "publisher": _first(origin["publisher"]),
        "location": _first(F.flatten(F.transform(origin["place"], lambda p: F.coalesce(p["placeTerm"], none)))), "journal": F.when(journal, title(host["titleInfo"])),
        "volumeTitle": F.coalesce(detail("title", "title"), F.when(~journal, title(host["titleInfo"]))), "pagination": F.when(last.isNull() | (last == first), first).otherwise(F.concat(first, F.lit("-"), last)),
        "bookContentInfo": _first(x["note"]), "publicationUrl": F.regexp_replace(_first(F.flatten(F.transform(x["location"], lambda q: F.coalesce(q["url"], none)))), r"\s+", ""),
    }
    details = lambda p: F.map_concat(_ids(p["nameIdentifier"]), _map([("affiliation", F.array_join(_list(p["affiliation"]), " & "))]))
    authors = F.transform(F.coalesce(people(x["name"], "Author"), F.filter(x["name"], lambda _: F.lit(False))), lambda p: _author(_first(p["namePart"]), details(p)))
    editors = _list(F.transform(people(host["name"], "Editor"), lambda p: _first(p["namePart"])))
    parsed = rows.withColumn("__x", F.from_xml(xml, F.lit(MODS_SCHEMA), {"ignoreNamespace": "true"}))
    return _with_record(parsed, to, F.coalesce(authors, _bare(none)), editors, _map(list(value.items())), _ids(x["identifier"]), kind).drop("__x")


def document_attributes(record: Column) -> Column:
    """What a document's attributes tell of its reference: identifiers, authors joined by " & ", title, year, link; with pages or a volume's title also its origin and first and last page."""
    get = lambda n: F.try_element_at(record["fields"], F.lit(n))
    inside = F.coalesce(get("pagination"), get("volumeTitle")).isNotNull()
    pages = F.split(F.trim(get("pagination")), r"\s*-+\s*")
    told = [
        ("docAuthor", F.array_join(F.transform(record["authors"], lambda a: a["name"]), " & ")), ("docTitle", get("title")), ("docDate", get("year")), ("docSource", get("publicationUrl")),
        ("docOrigin", F.when(inside, r.origin(*(get(n) for n in ("journal", "volume", "issue", "volumeTitle", "location", "publisher"))))),
        ("pageNumber", F.when(F.size(pages) <= 2, pages[0])), ("lastPageNumber", F.when(F.size(pages) == 2, F.get(pages, F.lit(1)))),
    ]
    return F.map_concat(F.transform_keys(record["ids"], lambda k, _: F.concat(F.lit("ID-"), k)), _map(told))


def clean_mods(xml: Column) -> Column:
    """MODS without the tags of other elements, whose text stays, and with its name space declared once."""
    own = F.regexp_replace(xml, r"</?(?!mods:)[A-Za-z_][^<>]*>", "")
    bare = F.regexp_replace(own, r'(<mods:mods\b[^<>]*?)\s+xmlns:mods="[^"]*"', "$1")
    return F.regexp_replace(bare, r"<mods:mods\b", f'<mods:mods xmlns:mods="{MODS}"')


def names_from_attributes(rows: DataFrame, attributes: str, text: str, to: str = "name") -> DataFrame:
    """rows with struct(epithets, hybrid, name, year, base_name, base_year) of tagged names: a map column of attributes first, else what the text says after the last epithet.

    Attributes: the ranks, hybrid, authorityName, authorityYear, baseAuthorityName,
    baseAuthorityYear. A stated year that isn't from 1000 to 2999 is no year; a year in the
    text counts only together with the name there.
    """
    get = lambda n: F.try_element_at(attributes, F.lit(n))
    rows = rows.withColumn("__e", F.map_filter(attributes, lambda k, v: k.isin(tx.NAMES) & v.isNotNull())).withColumn("__last", tx.most_significant_rank(F.col("__e")))
    rows = rows.withColumn("__both", tx.split_authority(tx.verbatim_authority(F.col(text), F.try_element_at("__e", F.col("__last")))))
    rows = rows.withColumn("__read", tx.parse_authority(F.col("__both.combination"))).withColumn("__base", tx.parse_authority(F.regexp_replace("__both.basionym", r"^\(|\)$", "")))
    out = []
    for p, attribute, read in (("", "authority", F.col("__read")), ("base_", "baseAuthority", F.col("__base"))):
        stated = F.when(get(f"{attribute}Year").rlike("^[12][0-9]{3}$"), get(f"{attribute}Year").cast("int"))
        found = F.length(read["name"]) > 0
        out += [F.coalesce(get(f"{attribute}Name"), F.when(found, read["name"])).alias(f"{p}name"), F.when(get(f"{attribute}Name").isNull() & found, F.coalesce(read["year"], stated)).otherwise(stated).alias(f"{p}year")]
    hybrid = F.coalesce(F.col("__last") == "species", F.lit(False)) & get("hybrid").isNotNull()
    return rows.withColumn(to, F.struct(F.col("__e").alias("epithets"), hybrid.alias("hybrid"), *out)).drop("__e", "__last", "__both", "__read", "__base")
