"""Formats of references, and the registry."""

from __future__ import annotations

import pytest

from marginalia.plans import references as plans
from marginalia.sources import references as rf

TAGGED = """

TY  - JOUR
ID  - a1
AU  - Doe, John
AU  - Roe, R.
TI  - A title that goes on
      in a second line
JF  - Some Journal
PY  - 1999/05/01
SP  - 12
EP  - 34
DO  - 10.1/x
ER  -

TY  - BOOK
TI  - Has no end
AU  - X
TY  - CHAP
AU  - Only, Author
ER  -
TY  - JOUR
T1  - Single page
SP  - 7
EP  - 7
ER  -"""
BRACED = """% a comment before
@article{key:1, author = {Doe, John and {van der Roe}, R.},
  title = "On {Ants} and {\\'E}tudes", journal={J. of X}, year = 1999, pages = {12--34}, number = {3}}
@Book{two,
  Title = {A {Nested {very} deep} one},
  date = {2001-03}
}
@misc{three, note = {no title here}}
@misc{four, title = {never closed}
@misc{title = {no key}}"""


def rows(spark, tmp_path, form, text):
    (tmp_path / "x.txt").write_text(text)
    return [r.asDict() for r in rf.read(spark, form, f"file://{tmp_path}/x.txt").collect()]


def test_tagged(spark, tmp_path):
    one, lost, bare, last = rows(spark, tmp_path, "tagged", TAGGED)
    assert {k: one[k] for k in rf.COLUMNS[:-2]} == {"id": "a1", "type": "JOUR", "author": ["Doe, John", "Roe, R."], "year": "1999", "title": "A title that goes on in a second line", "journal": "Some Journal", "volume": None, "issue": None, "pagination": "12-34", "doi": "10.1/x"}
    assert one["error"] is None and one["source"].startswith("TY  - JOUR\nID  - a1") and one["source"].rstrip().endswith("ER  -")
    assert (lost["error"], lost["title"], lost["source"]) == ("unfinished record", None, "TY  - BOOK\nTI  - Has no end\nAU  - X")
    assert bare["error"] == "no title" and bare["author"] is None and last["pagination"] == "7" and last["title"] == "Single page"


def test_braced(spark, tmp_path):
    comment, one, two, three, four, five = rows(spark, tmp_path, "braced", BRACED)
    assert comment["error"] == "no key"
    assert {k: one[k] for k in ("id", "type", "author", "title", "journal", "year", "pagination", "issue")} == {"id": "key:1", "type": "article", "author": ["Doe, John", "van der Roe, R."], "title": "On Ants and \\'E tudes", "journal": "J. of X", "year": "1999", "pagination": "12-34", "issue": "3"}
    assert (two["title"], two["year"], two["author"]) == ("A Nested very deep one", "2001", [])
    assert [x["error"] for x in (three, four, five)] == ["no title", "unbalanced braces", "no key"] and four["source"] == "@misc{four, title = {never closed}"


def test_large_files_are_split_and_nothing_is_lost(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join(f"TY  - JOUR\nID  - {k}\nTI  - Title {k} {'x' * 80}\nER  -\n" for k in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = rf.read(spark, "tagged", f"file://{tmp_path}/x.txt")
        assert found.rdd.getNumPartitions() > 4
        assert sorted(int(r.id) for r in found.filter("error IS NULL").collect()) == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_registry(spark, small, tmp_path):
    (tmp_path / "t.txt").write_text(TAGGED)
    (tmp_path / "b.txt").write_text(BRACED)
    of = rf.Registry()
    with pytest.raises(LookupError):
        of.find(year="1999")
    of.register("ants", lambda: rf.read(spark, "braced", f"file://{tmp_path}/b.txt"), lambda i: ":" in i)
    of.register("files", lambda: rf.read(spark, "tagged", f"file://{tmp_path}/t.txt"))
    assert of.names() == ["ants", "files"]
    assert [(r["in"], r.title) for r in of.get("a1").collect()] == [("files", "A title that goes on in a second line")]
    assert [r["in"] for r in of.get("key:1").collect()] == ["ants"]
    assert {(r["in"], r.id) for r in of.find(author="doe", year="1999").collect()} == {("ants", "key:1"), ("files", "a1")}
    assert [r.id for r in of.find(title="line title", journal="some").collect()] == ["a1"] and of.find(author="John").count() == 0
    with pytest.raises(ValueError, match="publisher"):
        of.find(publisher="x")
    assert plans.registry(spark, small).names() == ["braced", "tagged"]
