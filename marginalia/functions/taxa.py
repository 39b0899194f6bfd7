"""Column expressions on taxonomic names: ranks, epithets, authorities, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import refs

#: Ranks in their order, with group and epithet template; a short system of our own choice of common ranks.
RANKS = (
    ("kingdom", "kingdom", "@"), ("phylum", "phylum", "@"), ("class", "class", "@"), ("order", "order", "@"), ("family", "family", "@"), ("subFamily", "family", "@"),
    ("tribe", "tribe", "@"), ("genus", "genus", "@"), ("subGenus", "genus", "(@)"), ("section", "genus", "(sect. @)"), ("series", "genus", "(ser. @)"),
    ("species", "species", "@"), ("subSpecies", "species", "subsp. @"), ("variety", "species", "var. @"), ("form", "species", "f. @"),
)
NAMES = [r[0] for r in RANKS]
#: XML elements of ranks in the classic and the simple form, where they differ from dwcranks: and the rank; name spaces.
CLASSIC = {"kingdom": "Kingdom", "phylum": "Phylum", "class": "Class", "order": "Order", "family": "Family", "genus": "Genus", "species": "Species", "subSpecies": "Subspecies"}
SIMPLE = {"kingdom": "kingdom", "phylum": "phylum", "class": "class", "order": "order", "family": "family", "genus": "genus", "subGenus": "subgenus", "species": "speciesEpithet"}
CLASSIC_SPACE, SIMPLE_SPACE, RANK_SPACE = "http://digir.net/schema/conceptual/darwin/2003/1.0", "http://rs.tdwg.org/dwc/terms/", "http://rs.tdwg.org/UBIF/2006/Schema/1.1"
#: Fixed value: digits of the catalogue's identifiers.
BASE29 = "23456789BCDFGHJKLMNPQRSTVWXYZ"


def level(rank: Column) -> Column:
    """1-based order of a rank; -1 if unknown."""
    at = F.array_position(F.array(*map(F.lit, NAMES)), rank).cast("int")
    return F.when(at > 0, at).otherwise(-1)


def is_primary(rank: Column) -> Column:
    return rank.isin([n for n, g, _ in RANKS if n == g])


def _chosen(rank: Column, of: dict[str, str | None]) -> Column:
    out = F.lit(None).cast("string")
    for n, v in of.items():
        out = F.when(rank == n, F.lit(v)).otherwise(out)
    return out


def primary_parent(rank: Column) -> Column:
    primary = [n for n, g, _ in RANKS if n == g]
    return _chosen(rank, {n: next((p for p in reversed(primary) if NAMES.index(p) < k), None) for k, n in enumerate(NAMES)})


def primary_child(rank: Column) -> Column:
    primary = [n for n, g, _ in RANKS if n == g]
    return _chosen(rank, {n: next((p for p in primary if NAMES.index(p) > k), None) for k, n in enumerate(NAMES)})


def format_epithet(rank: Column, epithet: Column) -> Column:
    """An epithet by its rank's template; "" without one."""
    out = epithet
    for n, _, t in RANKS:
        if t != "@":
            out = F.when(rank == n, F.concat(F.lit(t.split("@")[0]), epithet, F.lit(t.split("@")[1]))).otherwise(out)
    return F.when(F.length(F.trim(epithet)) > 0, out).otherwise("")


def most_significant_rank(epithets: Column) -> Column:
    """The last rank in order that the map has an epithet for."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, NAMES)), lambda r: F.map_contains_key(epithets, r)), F.lit(-1))


def name_string(epithets: Column, authority: Column | None = None, hybrid: Column | None = None) -> Column:
    """To genus the own epithet; below, all epithets from genus on by their templates. Then the authority; a hybrid's sign comes before the last epithet."""
    last = most_significant_rank(epithets)
    genus = NAMES.index("genus") + 1
    parts = F.transform(F.filter(F.array(*map(F.lit, NAMES[genus - 1 :])), lambda r: F.map_contains_key(epithets, r)), lambda r: F.concat(F.when((r == last) & (F.lit(False) if hybrid is None else hybrid), "× ").otherwise(""), format_epithet(r, F.try_element_at(epithets, r))))
    name = F.when(level(last) <= genus, F.try_element_at(epithets, last)).otherwise(F.array_join(parts, " "))
    return name if authority is None else F.concat_ws(" ", name, F.when(authority != "", authority))


def split_authority(c: Column) -> Column:
    """struct(basionym, combination): a leading part in parentheses is the basionym's, the rest the combination's; without one, all is the combination's. A year after parentheses alone belongs to the basionym."""
    head, rest = F.regexp_extract(c, r"^(\([^()]*\))\s*(.*)$", 1), F.regexp_extract(c, r"^(\([^()]*\))\s*(.*)$", 2)
    late = rest.rlike(r"^,?\s*[12][0-9]{3}$")
    inner = F.when(late, F.concat(F.regexp_replace(head, r"\)$", ""), F.lit(", "), F.regexp_extract(rest, "[12][0-9]{3}", 0), F.lit(")"))).otherwise(head)
    return F.struct(F.when(head != "", inner).alias("basionym"), F.when(head == "", c).when(~late & (rest != ""), rest).alias("combination"))


def parse_authority(c: Column) -> Column:
    """struct(name, year): the first year, and what comes before it without punctuation at its ends."""
    found = F.regexp_extract(c, "[12][0-9]{3}", 0)
    before = F.when(found != "", F.split(c, found, 2)[0]).otherwise(c)
    return F.struct(F.regexp_replace(before, r"^[\s\p{P}]+|[\s,;:()\[\]]+$", "").alias("name"), F.when(found != "", found.cast("int")).alias("year"))


def verbatim_authority(text: Column, epithet: Column) -> Column:
    """What follows the last occurrence of the epithet."""
    return F.when(text.contains(epithet), F.trim(F.element_at(F.split(text, epithet), -1)))


def show_authority(base: Column, combination: Column) -> Column:
    """(base) combination."""
    return F.concat_ws(" ", F.concat(F.lit("("), base, F.lit(")")), combination)


def to_base29(n: Column) -> Column:
    """A number that isn't negative in the catalogue's digits."""
    def digit(a: Column, _: Column) -> Column:
        rest = F.call_function("div", a["rest"], F.lit(29).cast("long"))
        more = F.struct(rest.alias("rest"), F.concat(F.substring(F.lit(BASE29), (a["rest"] % 29 + 1).cast("int"), F.lit(1)), a["text"]).alias("text"))
        return F.when((a["rest"] == 0) & (a["text"] != ""), a).otherwise(more)

    start = F.struct(n.cast("long").alias("rest"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, digit, lambda a: a["text"])  # a long has 13 digits at most


def from_base29(c: Column) -> Column:
    digits = F.array(*map(F.lit, BASE29))
    return F.aggregate(F.split(F.upper(c), ""), F.lit(0).cast("long"), lambda a, d: a * 29 + (F.array_position(digits, d) - 1))


def matches(value: Column, query: Column, prefix: bool, case_sensitive: bool) -> Column:
    """Equality or prefix, with or without regard to case."""
    v, q = (value, query) if case_sensitive else (F.lower(value), F.lower(query))
    return F.startswith(v, q) if prefix else v == q


def clean_epithet(c: Column) -> Column:
    """Lower-case letters and hyphens; other characters as hyphens; null if no letter is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z]+", "-"), "^-+|-+$", "")
    return F.when(t != "", t)


def segment_name(c: Column) -> Column:
    """struct(prefix, epithet, authority) of a name: words up to the last lower-case epithet, or the first word alone; markers of infraspecific ranks belong to the prefix."""
    pattern = r"^((?:\p{Lu}[\p{Ll}-]+ )(?:\([^()]+\) )?(?:\p{Ll}[\p{Ll}-]+ )?(?:(?:subsp|var|f|subvar)\. )?)(\p{Ll}[\p{Ll}-]+)(?: (.*))?$"
    one = r"^(\p{Lu}[\p{Ll}-]+)(?: (.*))?$"
    two = c.rlike(pattern)
    return F.struct(F.when(two, F.trim(F.regexp_extract(c, pattern, 1))).otherwise("").alias("prefix"), F.when(two, F.regexp_extract(c, pattern, 2)).otherwise(F.regexp_extract(c, one, 1)).alias("epithet"), F.when(two, F.regexp_extract(c, pattern, 3)).otherwise(F.regexp_extract(c, one, 2)).alias("authority"))


def _other(rank: str) -> str:
    return rank.lower() + ("Epithet" if NAMES.index(rank) >= NAMES.index("species") else "")


def to_dwc(epithets: Column, authority: Column, simple: bool = False) -> Column:
    """A name as XML with an element for each rank, then its rank and authority; classic or simple elements."""
    own, space = (SIMPLE, SIMPLE_SPACE) if simple else (CLASSIC, CLASSIC_SPACE)
    rank = most_significant_rank(epithets)
    each = [refs.element(f"dwc:{own[n]}" if n in own else f"dwcranks:{_other(n)}", F.try_element_at(epithets, F.lit(n))) for n in NAMES]
    end = F.when(rank.isNotNull(), F.concat(refs.element("dwc:taxonRank", F.lower(rank)), refs.element("dwc:scientificNameAuthorship", authority))).otherwise("")
    return F.concat(F.lit(f'<taxonomicName xmlns:dwc="{space}" xmlns:dwcranks="{RANK_SPACE}">'), *each, end, F.lit("</taxonomicName>"))


def from_dwc(xml: Column) -> Column:
    """struct(epithets, authority) of such XML, whichever form its elements have; of repeated elements the first."""
    pattern = F.lit(r"<(?:\w+:)?(\w+)>([^<]*)</")
    names, values = F.regexp_extract_all(xml, pattern, F.lit(1)), F.regexp_extract_all(xml, pattern, F.lit(2))
    get = lambda e: F.when(F.array_contains(names, e), refs.xml_unescape(F.get(values, F.array_position(names, e).cast("int") - 1)))
    found = [F.coalesce(*(get(e) for e in dict.fromkeys(x for x in (CLASSIC.get(n), SIMPLE.get(n), _other(n)) if x))) for n in NAMES]
    return F.struct(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*found)), lambda _, v: v.isNotNull()).alias("epithets"), get("scientificNameAuthorship").alias("authority"))
