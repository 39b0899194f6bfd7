"""Column expressions for bibliographic values: sanitising, identifiers, hashes, formatted strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.tokens import fold_accents, is_roman, roman_value

#: Unicode blanks and dashes that count as " " and "-".
BLANKS = "\\u00A0\\u2000-\\u200B\\u3000"
DASHES = "\\u2010-\\u2015\\u2212"


def clean_string(c: Column) -> Column:
    """Blanks as " ", dashes as "-", runs of blanks as one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"[{DASHES}]", "-"), f"[{BLANKS}\\s]+", " "))


def year(c: Column) -> Column:
    """A year from 1000 to 2999, Roman ones too; else null."""
    t = F.trim(c)
    value = F.when(t.rlike("^[12][0-9]{3}$"), t).when(is_roman(t), roman_value(t).cast("string"))
    return F.when(value.rlike("^[12][0-9]{3}$"), value)


def _range(first: Column, second: Column, prefix: Column) -> Column:
    """first-second, a shorter second bound being completed with the first one's beginning; null if it falls."""
    whole = F.when(F.length(second) < F.length(first), F.concat(F.substring(first, F.lit(1), F.length(first) - F.length(second)), second)).otherwise(second)
    return F.when(whole.cast("long") > first.cast("long"), F.concat(prefix, first, F.lit("-"), whole))


def part(c: Column, prefixes: str = "es") -> Column:
    """A volume, issue or number: digits without leading zeros, maybe after a prefix letter, or a rising range of them; else null."""
    t = F.lower(clean_string(c))
    single, pair = f"^([{prefixes}]?)0*([0-9]+)$", f"^([{prefixes}]?)0*([0-9]+)-0*([0-9]+)$"
    get = lambda pattern, k: F.regexp_extract(t, pattern, k)
    return F.when(t.rlike(single), F.concat(get(single, 1), get(single, 2))).when(t.rlike(pair), _range(get(pair, 2), get(pair, 3), get(pair, 1)))


def pagination(c: Column) -> Column:
    """A page or a rising range of pages; a Roman page is its number; else null."""
    t = clean_string(c)
    return F.when(is_roman(t), roman_value(t).cast("string")).otherwise(part(t, "e"))


def period_end(c: Column) -> Column:
    """yyyy, yyyy-MM or yyyy-MM-dd as a date, completed to the period's end; else null."""
    t = F.trim(c)
    full = F.when(t.rlike("^[12][0-9]{3}$"), F.concat(t, F.lit("-12-31"))).when(t.rlike("^[12][0-9]{3}-[0-9]{2}$"), F.last_day(F.try_to_timestamp(F.concat(t, F.lit("-01")), F.lit("yyyy-MM-dd"))).cast("string")).when(t.rlike("^[12][0-9]{3}-[0-9]{2}-[0-9]{2}$"), t)
    return F.to_date(F.try_to_timestamp(full, F.lit("yyyy-MM-dd"))).cast("string")


def doi(c: Column) -> Column:
    """A DOI without blanks and resolver; null if it isn't 10.N/..."""
    t = F.regexp_replace(F.regexp_replace(c, "\\s+", ""), "^(?i)(https?://(dx\\.)?doi\\.org/|doi:)", "")
    return F.when(t.rlike("^10\\.[0-9]+(\\.[0-9]+)*/.+"), t)


def light_hash(c: Column) -> Column:
    """A title without tags, accents, case, blanks and punctuation."""
    return F.regexp_replace(F.lower(fold_accents(F.regexp_replace(c, "<[^>]+>", ""))), "[^a-z0-9]", "")


def part_number(c: Column) -> Column:
    """The first Arabic or Roman number among the words; else 0."""
    words = F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z]+|[0-9]+"), F.lit(0)), lambda w: w.rlike("^[0-9]{1,9}$") | is_roman(w))
    first = F.try_element_at(words, F.lit(1))
    return F.coalesce(F.when(first.rlike("^[0-9]+$"), first.cast("int")).otherwise(roman_value(first)), F.lit(0))


def first_pages(c: Column) -> Column:
    """The first page range or number of a pagination, page counts ("12 pp") left out."""
    t = F.regexp_replace(clean_string(c), "[0-9]+ ?(pp|pages|p)\\b\\.?", "")
    found = F.regexp_extract(t, "[0-9]+-[0-9]+|[0-9]+", 0)
    return F.when(found != "", pagination(found))


def upgraded_type(kind: Column, pages: Column) -> Column:
    """A book or volume of which a page range is given is a chapter or article."""
    ranged = pages.contains("-")
    return F.when(ranged & (kind == "book"), "book chapter").when(ranged & (kind == "journal volume"), "journal article").otherwise(kind)


def persons(names: Column, most: int, most_chars: int, separator: str = ", ", last: str = " & ") -> Column:
    """At most so many names and characters, with "et al." for the rest; one name at least."""
    kept = F.aggregate(names, F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("chars")), lambda a, x: F.when((a["n"] < most) & ((a["n"] == 0) | (a["chars"] + F.length(x) <= most_chars)) & (a["chars"] >= 0), F.struct((a["n"] + 1).alias("n"), (a["chars"] + F.length(x)).alias("chars"))).otherwise(F.struct(a["n"].alias("n"), F.lit(-1).cast("int").alias("chars"))), lambda a: a["n"])
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(F.lit(1), F.size(names) - 1)), separator)
    whole = F.when(F.size(names) > 1, F.concat(head, F.lit(last), F.element_at(names, -1))).otherwise(F.array_join(names, ""))
    return F.when(F.size(names) == 0, "").when(kept == F.size(names), whole).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), kept), separator), F.lit(" et al.")))


def origin(journal: Column, volume: Column, issue: Column, volume_title: Column, location: Column, publisher: Column) -> Column:
    """What a search for a reference asks as its origin: journal and number, else volume title, else place and publisher."""
    return F.coalesce(F.when(journal.isNotNull(), F.concat_ws(" ", journal, F.coalesce(volume, issue))), volume_title, F.concat(location, F.lit(": "), publisher), location, publisher)


def journal_or_publisher(text: Column, has_part: Column) -> Column:
    """struct(journal, publisher, location): with a part designator a journal; "a: b" and "b, a" are a place and a publisher; else a publisher."""
    colon, comma = F.split(text, ": ", 2), F.split(text, ", ", 2)
    two, by = text.contains(": "), text.contains(", ")
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(has_part, text).alias("journal"),
        F.when(has_part, none).when(two, colon[1]).when(by, comma[0]).otherwise(text).alias("publisher"),
        F.when(has_part, none).when(two, colon[0]).when(by, comma[1]).alias("location"),
    )


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def xml_unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def element(name: str, c: Column) -> Column:
    """An XML element, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), xml_escape(c), F.lit(f"</{name}>")), F.lit(""))


def to_xml(fields: list[tuple[str, Column]], authors: Column) -> Column:
    """A record as XML, with its fields in the given order and an element for each author first."""
    each = F.array_join(F.transform(authors, lambda a: element("author", a)), "")
    return F.concat(F.lit("<bibRef>"), each, *(element(n, c) for n, c in fields), F.lit("</bibRef>"))


def reference_string(authors: Column, year_: Column, title: Column, host: Column, pages: Column, doi_: Column) -> Column:
    """authors (year): title. host: pages. DOI."""
    return F.concat(
        F.coalesce(F.concat(authors, F.lit(" ")), F.lit("")), F.coalesce(F.concat(F.lit("("), year_.cast("string"), F.lit("): ")), F.lit("")), title,
        F.coalesce(F.concat(F.lit(". "), host), F.lit("")), F.coalesce(F.concat(F.lit(": "), pages), F.lit("")), F.coalesce(F.concat(F.lit(". https://doi.org/"), doi_), F.lit("")),
    )


#: Named formatters of a record with the columns author, year, title, journal, volume, pagination; names count in any case.
STYLES = {
    "short": lambda: F.concat_ws(" ", "author", "year"),
    "title first": lambda: F.concat_ws(", ", "title", "author", "year"),
    "journal": lambda: F.concat_ws(" ", "journal", F.concat(F.col("volume"), F.lit(":")), "pagination"),
}


def in_style(name: str) -> Column:
    """The formatter of a name; KeyError if there is none."""
    return {k.lower(): f for k, f in STYLES.items()}[name.lower()]()
