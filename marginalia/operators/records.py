"""Reference records: rules, classification, merging, attribute maps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RecordType:
    """A type with its constraints; a record of the type has no errors. Stricter types win."""

    name: str
    strictness: int
    required: tuple[tuple[str, ...], ...] = ()  # any of each group
    excluded: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()  # attribute, regex of the whole value
    conditions: tuple[tuple[str, str], ...] = field(default=())  # SQL, error

    def errors(self) -> Column:
        """Array of distinct errors in the order of constraints."""
        found = [F.when(F.coalesce(*(F.col(a).cast("string") for a in group)).isNull(), f"missing {' or '.join(group)}") for group in self.required]
        found += [F.when(F.col(a).isNotNull(), f"unexpected {a}") for a in self.excluded]
        found += [F.when(~F.col(a).cast("string").rlike(f"^({p})$"), f"invalid {a}") for a, p in self.patterns]
        found += [F.when(~F.coalesce(F.expr(c), F.lit(False)), e) for c, e in self.conditions]
        return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


PAGES = r"[0-9]+(-[0-9]+)?"
#: Our own rules for the usual types.
TYPES = (
    RecordType("journal article", 5, (("author",), ("year",), ("title",), ("journal",), ("volume", "issue"), ("pagination",)), ("publisher",), (("year", "[12][0-9]{3}"), ("pagination", PAGES))),
    RecordType("book chapter", 4, (("author",), ("year",), ("title",), ("volume_title",), ("pagination",)), ("journal",), (("year", "[12][0-9]{3}"), ("pagination", r"[0-9]+-[0-9]+"))),
    RecordType("journal volume", 3, (("year",), ("journal",), ("volume", "issue")), ("pagination",), (("year", "[12][0-9]{3}"),)),
    RecordType("book", 2, (("author",), ("year",), ("title",), ("publisher", "location")), ("journal", "volume_title"), (("year", "[12][0-9]{3}"),), (("pagination IS NULL OR pagination NOT LIKE '%-%'", "a range of pages"),)),
    RecordType("url", 1, (("title",), ("doi",)), ()),
)


def classify(types: tuple[RecordType, ...] = TYPES) -> Column:
    """Name of the strictest type without errors, the first of equals; null if there is none."""
    fits = [F.when(F.size(t.errors()) == 0, F.struct(F.lit(t.strictness).alias("s"), F.lit(-k).alias("k"), F.lit(t.name).alias("name"))) for k, t in enumerate(types)]
    return F.greatest(*fits)["name"]


def check(kind: Column, types: tuple[RecordType, ...] = TYPES) -> Column:
    """Errors of a record by its stated type; an unknown type is an error."""
    out = F.array(F.lit("unknown type"))
    for t in types:
        out = F.when(kind == t.name, t.errors()).otherwise(out)
    return out


def merge(records: DataFrame, by: Column, order: str, attributes: list[str]) -> DataFrame:
    """One record for each value of by, rows without one as they are: each attribute's first value that isn't null, in the given order."""
    first = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col(order))).alias(a) for a in attributes]
    keyed = records.withColumn("__by", by)
    alone = keyed.filter("__by IS NULL").select(order, *attributes)
    return keyed.filter("__by IS NOT NULL").groupBy("__by").agg(F.min(order).alias(order), *first).select(order, *attributes).unionByName(alone)


def first_source(records: DataFrame, key: str, priority: str) -> DataFrame:
    """All records of each key's first source that has any."""
    w = Window.partitionBy(key)
    return records.withColumn("__p", F.min(priority).over(w)).filter(F.col("__p") == F.col(priority)).drop("__p")


def with_prefix(attributes: Column, prefix: str) -> Column:
    """Attribute map whose keys get a prefix, null values removed."""
    return F.transform_keys(F.map_filter(attributes, lambda k, x: x.isNotNull()), lambda k, x: F.concat(F.lit(prefix), k))


def without_prefix(attributes: Column, prefix: str) -> Column:
    """Those attributes whose keys have the prefix, without it."""
    return F.transform_keys(F.map_filter(attributes, lambda k, x: k.startswith(prefix)), lambda k, x: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def load_types(xml: str, base: tuple[RecordType, ...] = (), replace: bool = False, merge_checks: bool = False) -> tuple[RecordType, ...]:
    """Types of a rule file, after those of base. A type that base has is replaced, or gets the file's checks too, or else stays as it is.

    <types><type name="" strictness=""><require any="a b"/><exclude attribute=""/><pattern attribute="" regex=""/><condition sql="" error=""/></type></types>
    """
    import xml.etree.ElementTree as ET

    found = {t.name: t for t in base}
    for e in ET.fromstring(xml).iter("type"):
        t = RecordType(
            e.attrib["name"], int(e.attrib.get("strictness", 0)),
            tuple(tuple(x.attrib["any"].split()) for x in e.iter("require")), tuple(x.attrib["attribute"] for x in e.iter("exclude")),
            tuple((x.attrib["attribute"], x.attrib["regex"]) for x in e.iter("pattern")), tuple((x.attrib["sql"], x.attrib["error"]) for x in e.iter("condition")),
        )
        old = found.get(t.name)
        if old is None or replace:
            found[t.name] = t
        elif merge_checks:
            found[t.name] = RecordType(old.name, old.strictness, old.required + t.required, old.excluded + t.excluded, old.patterns + t.patterns, old.conditions + t.conditions)
    return tuple(found.values())
