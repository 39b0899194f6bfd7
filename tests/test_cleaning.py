"""Replacement rules as tables, and the cascade of row cleaning, by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import taxa
from marginalia.operators import cleaning as cl

COLUMNS = ("id", "parent", "valid", "status", "code", "rank", "name", "genus", "species", "below", "published", "remarks", "references")


def rules(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], cl.RULES)


def values(spark, given, made, fields=("name",)):
    df = spark.createDataFrame([(str(k), *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(given)], "id string, " + ", ".join(f"{f} string" for f in fields))
    return [tuple(r)[1:] if len(fields) > 1 else r[1] for r in cl.normalised(df, list(fields), made).orderBy(F.col("id").cast("int")).collect()]


def test_precedence(spark):
    made = rules(spark, ("1", "name", "key", "", "of key"), ("", "name", "literal", "b c", "of value"), (None, None, "character", "[xX]", "y"), ("", "name", "pattern", "old (.*)", "new"), ("", "rank", "literal", "b c", "no"), ("", "name", "literal", "b c", "of the last"), ("", "name", "pattern", "a+", "$_b_$"), ("5", "name", "key", "", ""))
    got = values(spark, ["b c", "b c", "max ,(  k", "old thing", "caat", "gone", None, "a a a"], made)
    assert got == ["of the last", "of key", "mby, (k", "new", "cbt", "", None, "b b b"]


def test_rules_that_never_end_and_those_that_take_long(spark):
    made = rules(spark, ("", "name", "pattern", "ping", "pong"), ("", "name", "pattern", "pong", "ping"), *(("", "name", "pattern", f"n{k}", f"n{k + 1}") for k in range(200)))
    got = values(spark, ["ping", "n0", "n150", "other"], made)
    assert got[0] in ("ping", "pong") and got[1:] == ["n200", "n200", "other"]


def test_many_rules_are_tables(spark):
    sizes = []
    for n in (10, 100_000):
        made = spark.range(n).select(F.col("id").alias("ord"), F.lit("").alias("key"), F.lit("name").alias("field"), F.lit("literal").alias("kind"), F.concat(F.lit("v"), "id").alias("value"), F.concat(F.lit("w"), "id").alias("replacement"))
        df = cl.normalised(spark.createDataFrame([("a", "v7"), ("b", "v99999")], "id string, name string"), ["name"], made)
        assert {tuple(r) for r in df.collect()} == {("a", "w7"), ("b", "w99999" if n > 10 else "v99999")}
        sizes.append(len(df._jdf.queryExecution().analyzed().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("// comment\n\tname\tP:a+\t$_b\n\tname\tx\ty\n7\tname\t\tz\n8\t\tREMOVE\nshort\n\tname\tw\n")
    (tmp_path / "c.tsv").write_text("//\n[q]\tk\n")
    got = cl.read_rules(spark, f"file://{tmp_path}/v.tsv", f"file://{tmp_path}/c.tsv")
    assert {tuple(r)[1:] for r in got.collect()} == {("", "name", "pattern", "a+", "$_b"), ("", "name", "literal", "x", "y"), ("7", "name", "key", "", "z"), ("8", "", "remove", "REMOVE", ""), ("", "name", "literal", "w", ""), (None, None, "character", "[q]", "k")}


def cleaned(spark, *rows, made=None):
    shape = ", ".join(f"{c} string" for c in COLUMNS)
    given = [(str(k), "p", "v", r.get("status", "accepted"), r.get("code"), r.get("rank"), r.get("name"), r.get("genus"), r.get("species"), r.get("below"), "pub", "rem", "ref") for k, r in enumerate(rows)]
    return [r.asDict() for r in cl.clean(spark.createDataFrame(given, shape), made if made is not None else rules(spark)).orderBy(F.col("id").cast("int")).collect()]


def test_removed_rows_keep_their_links(spark):
    bad = [{"code": "ICVCN", "rank": "genus", "name": "Virus"}, {"status": "MISAPPLIED", "rank": "genus", "name": "Abies"}, {"rank": "rank", "name": "Abies"}, {"rank": "genus"}, {"rank": "genus", "name": " "}, {"rank": "genus", "name": "Abiés"}, {"rank": "species", "name": "Abies"}, {"rank": "subspecies", "name": "Abies alba minor", "species": "alba"}, {"rank": "genus", "name": "Removed"}]
    got = cleaned(spark, *bad, made=rules(spark, ("8", "", "remove", "REMOVE", "")))
    for k, r in enumerate(got):
        assert r == dict.fromkeys(r) | {"id": str(k), "parent": "p", "valid": "v", "status": "REMOVED TAXON"}


def test_rows_by_rank(spark):
    rows = [
        {"rank": "Family", "name": "Pinaceae lindley, 1836"},
        {"rank": "genus", "name": "Abies Mill."},
        {"rank": "subgenus", "name": "Abies (Picea) (L.) Doe"},
        {"rank": "section", "name": "Abies (sect. Balsam) Doe"},
        {"rank": "species", "name": "Abies alba Mill., 1768", "genus": "Abies", "species": "alba"},
        {"rank": "species", "name": "Abies (Picea) alba (de la Cruz, 1768)"},
        {"rank": "subsp.", "name": "Abies alba subsp. minor Doe, 18999", "species": "alba", "below": "minor"},
        {"rank": "infraspecific name", "name": "Abies alba var. Minor x Doe", "genus": "Abies", "species": "alba", "below": "var. Minor x"},
        {"rank": "species", "name": "ABIES Alba 1nana Doe", "genus": "ABIES", "species": "Alba 1nana"},
        {"rank": "genus", "name": "AbiÃ©s Mill."},
    ]
    got = cleaned(spark, *rows, made=rules(spark, (None, None, "character", "é", "e")))
    show = [(r["rank"], r["name"], r["genus"], r["species"], r["below"], r["authority"], r["problems"]) for r in got]
    assert show == [
        ("family", "Pinaceae Lindley, 1836", None, None, None, "Lindley, 1836", []),
        ("genus", "Abies Mill.", "Abies", None, None, "Mill.", []),
        ("subGenus", "Abies (Picea) (L.) Doe", "Abies", None, None, "(L.) Doe", []),
        ("section", "Abies (sect. Balsam) Doe", "Abies", None, None, "Doe", []),
        ("species", "Abies alba Mill., 1768", "Abies", "alba", None, "Mill., 1768", []),
        ("species", "Abies (Picea) alba (de la Cruz, 1768)", "Abies", "alba", None, "(de la Cruz, 1768)", []),
        ("subSpecies", "Abies alba subsp. minor Doe, 18999", "Abies", "alba", "minor", "Doe, 18999", ["broken year 'Doe, 18999'"]),
        ("variety", "Abies alba minor-x Doe", "Abies", "alba", "minor-x", "Doe", ["invalid subSpecies 'var. Minor x'"]),
        ("species", "Abies alba-1nana Doe", "Abies", "alba-1nana", None, "Doe", ["invalid genus 'ABIES'", "invalid species 'Alba 1nana'"]),
        ("genus", "Abies Mill.", "Abies", None, None, "Mill.", []),
    ]
    assert all(r["published"] is r["remarks"] is r["references"] is None and r["status"] == "accepted" for r in got)


def test_identifiers_of_any_length(spark):
    numbers = [0, 5, 28, 29, 29**7 + 5, 2**53 + 1, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", taxa.to_base29(F.col("n")).alias("c")).withColumn("back", taxa.from_base29(F.col("c"))).collect()
    assert all(r.n == r.back for r in got) and len({r.c for r in got}) == len(numbers)
