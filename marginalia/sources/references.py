"""References from files of several formats, each record with its text and its error, and a registry of sources to get and find them in.

Files are read by Spark's text source, whose separator is what a record begins with. So any
file system that Spark knows will do, a large file is split over tasks, and a record that can't be
parsed is a row with an error like any other. Columns are expressions on that text: what a query
doesn't ask for isn't parsed, and a filter is applied before the other columns are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("id", "type", "author", "year", "title", "journal", "volume", "issue", "pagination", "doi", "source", "error")
#: Tags of the tagged format, and fields of the braced one, by column; of several the first that a record has.
TAGS = {"id": ("ID",), "author": ("AU", "A1"), "year": ("PY", "Y1"), "title": ("TI", "T1"), "journal": ("JO", "JF", "T2"), "volume": ("VL",), "issue": ("IS",), "doi": ("DO",)}
FIELDS = {"author": ("author",), "year": ("year", "date"), "title": ("title",), "journal": ("journal", "journaltitle", "booktitle"), "volume": ("volume",), "issue": ("number", "issue"), "pagination": ("pages",), "doi": ("doi",)}


@dataclass(frozen=True)
class Format:
    """separator: what a record begins with; parse: columns of a record's text without it, id to doi, the text as it was, and the error (null if there is none)."""

    separator: str
    parse: Callable[[Column], dict[str, Column]]


def _first(values: Column) -> Column:
    return F.nullif(F.trim(F.get(values, F.lit(0))), F.lit(""))


def _tagged(text: Column) -> dict[str, Column]:
    body = F.regexp_replace(text, r"^\s*(TY  - ?)?", "")
    lines = F.split(F.regexp_replace(body, r"\r?\n(?![A-Z][A-Z0-9]  -)\s*", " "), r"\r?\n")
    of = lambda tag: F.transform(F.filter(lines, lambda x: x.startswith(f"{tag}  -")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    several = lambda tags: F.concat(*map(of, tags))
    out = {c: _first(several(t)) for c, t in TAGS.items() if c != "author"}
    ends = F.filter(F.array(_first(of("SP")), _first(of("EP"))), lambda x: x.isNotNull())
    out |= {"type": _first(lines), "author": several(TAGS["author"]), "pagination": F.nullif(F.array_join(F.array_distinct(ends), "-"), F.lit(""))}
    out |= {"year": F.nullif(F.regexp_extract(out["year"], "[0-9]{4}", 0), F.lit("")), "source": F.concat(F.lit("TY  - "), F.regexp_replace(body, r"\s+$", ""))}
    out["error"] = F.when(~F.exists(lines, lambda x: x.startswith("ER  -")), "unfinished record").when(out["title"].isNull(), "no title")
    return out


def _braced(text: Column) -> dict[str, Column]:
    body = F.regexp_replace(text, r"^\s*@?", "")
    pattern = r"""(?s)(\w+)\s*=\s*(\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|"[^"]*"|[0-9]+)"""
    part = lambda k: F.regexp_extract_all(body, F.lit(pattern), F.lit(k))
    pairs = F.arrays_zip(F.transform(part(1), F.lower).alias("name"), part(2).alias("value"))
    plain = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r'^["{]|["}]$', ""), r"[{}]|\s+", " "))
    clean = lambda v: F.regexp_replace(F.regexp_replace(plain(v), " +", " "), r" (?=[,.;:])", "")
    named = lambda name: F.filter(pairs, lambda x: x["name"] == name)
    of = lambda names: _first(F.transform(F.concat(*map(named, names)), lambda x: clean(x["value"])))
    out = {c: of(n) for c, n in FIELDS.items()}
    out["author"] = F.when(out["author"].isNotNull(), F.split(out["author"], r"\s+and\s+")).otherwise(F.array().cast("array<string>"))
    out |= {"id": F.nullif(F.trim(F.regexp_extract(body, r"^\w+\s*\{\s*([^,\s]+)\s*,", 1)), F.lit("")), "type": F.lower(F.regexp_extract(body, r"^\w+", 0)), "source": F.concat(F.lit("@"), F.regexp_replace(body, r"\s+$", ""))}
    out |= {"year": F.nullif(F.regexp_extract(out["year"], "[0-9]{4}", 0), F.lit("")), "pagination": F.regexp_replace(out["pagination"], "-+", "-")}
    count = lambda c: F.regexp_count(body, F.lit(c))
    out["error"] = F.when(out["id"].isNull(), "no key").when(count(r"\{") != count(r"\}"), "unbalanced braces").when(out["title"].isNull(), "no title")
    return out


FORMATS = {"tagged": Format("\nTY  -", _tagged), "braced": Format("\n@", _braced)}


def read(spark: SparkSession, form: str, path: str | list[str]) -> DataFrame:
    """COLUMNS of the references in files of a format (a key of FORMATS). Attributes of a record with an error are null; its source is kept."""
    made = FORMATS[form]
    text = spark.read.option("lineSep", made.separator).schema("value string").text(path).filter(F.col("value").rlike(r"\S"))
    columns = made.parse(F.col("value"))
    attributes = [F.when(columns["error"].isNull(), columns[c]).alias(c) for c in COLUMNS[:-2]]
    return text.select(*attributes, columns["source"].alias("source"), columns["error"].alias("error"))


class Registry:
    """Named sources of references; each is a function that gives their DataFrame of COLUMNS, and maybe one that says which ids it can have."""

    def __init__(self) -> None:
        self._sources: dict[str, tuple[Callable[[], DataFrame], Callable[[str], bool]]] = {}

    def register(self, name: str, load: Callable[[], DataFrame], suitable: Callable[[str], bool] = lambda _: True) -> None:
        """A name that is registered already gets the new source."""
        self._sources[name] = (load, suitable)

    def names(self) -> list[str]:
        return sorted(self._sources)

    def get(self, number: str) -> DataFrame:
        """The references with this id in all sources that can have it, with the source's name (in)."""
        return self._union([n for n, (_, suitable) in self._sources.items() if suitable(number)]).filter(F.col("id") == number)

    def find(self, **wanted: str) -> DataFrame:
        """The references of all sources that have all properties: author, one author's last name; title, journal, all words in any order; others as they are, case aside."""
        unknown = set(wanted) - set(COLUMNS[:-2])
        if unknown:
            raise ValueError(f"no such properties: {sorted(unknown)}")
        found = self._union(list(self._sources)).filter("error IS NULL")
        for name, value in wanted.items():
            found = found.filter(_has(name, value))
        return found

    def _union(self, names: list[str]) -> DataFrame:
        if not names:
            raise LookupError("no source is registered for this")
        parts = [self._sources[n][0]().select(F.lit(n).alias("in"), *COLUMNS) for n in sorted(names)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _has(name: str, value: str) -> Column:
    value = value.lower().strip()
    if name == "author":
        last = lambda a: F.lower(F.when(a.contains(","), F.substring_index(a, ",", 1)).otherwise(F.substring_index(a, " ", -1)))
        return F.exists("author", lambda a: F.trim(last(a)) == value)
    if name in ("title", "journal"):
        own = F.split(F.lower(F.col(name)), r"[^\p{L}0-9]+")
        return F.forall(F.array(*map(F.lit, value.split())), lambda w: F.array_contains(own, w))
    return F.lower(F.col(name)) == value
