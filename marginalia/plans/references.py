"""Queries on files of references, written from parts in two formats, broken records among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import references as rf
from ..sources.files import shared_path

C = F.col


def _year():
    return F.concat(F.lit("19"), F.lpad((C("p_size") % 100).cast("string"), 2, "0"))


def tagged(s, d):
    """Every eleventh part has no end, every thirteenth no title."""
    title = F.when(C("p_partkey") % 13 == 0, "").otherwise(F.concat(F.lit("\nTI  - "), "p_name", F.lit("\n  of parts")))
    end = F.when(C("p_partkey") % 11 == 0, "").otherwise("\nER  - ")
    text = F.concat(F.lit("TY  - JOUR\nID  - t"), C("p_partkey").cast("string"), title, F.lit("\nAU  - Doe, J.\nA1  - "), "p_brand", F.lit(", K.\nPY  - "), _year(), F.lit("/05/\nJO  - "), "p_type", F.lit("\nSP  - "), C("p_size").cast("string"), F.lit("\nEP  - "), (C("p_size") + 9).cast("string"), end)
    path = shared_path(s, "tagged")
    table(s, d, "part").repartition(3, "p_partkey").select(text.alias("value")).write.text(path)
    return rf.read(s, "tagged", path)


def braced(s, d):
    """Every eleventh part lacks a brace, every thirteenth a title."""
    title = F.when(C("p_partkey") % 13 == 0, "").otherwise(F.concat(F.lit("  title = {{"), "p_name", F.lit("} of {Parts}},\n")))
    end = F.when(C("p_partkey") % 11 == 0, "").otherwise("\n}")
    text = F.concat(F.lit("@Article{b"), C("p_partkey").cast("string"), F.lit(",\n"), title, F.lit('  author = "Doe, J. and Roe, R.",\n  year = '), _year(), F.lit(",\n  journal = {"), "p_type", F.lit("},\n  pages = {"), C("p_size").cast("string"), F.lit("--"), (C("p_size") + 9).cast("string"), F.lit("}"), end)
    path = shared_path(s, "braced")
    table(s, d, "part").repartition(3, "p_partkey").select(text.alias("value")).write.text(path)
    return rf.read(s, "braced", path)


def registry(s, d):
    of = rf.Registry()
    of.register("tagged", lambda: tagged(s, d), lambda i: i.startswith("t"))
    of.register("braced", lambda: braced(s, d), lambda i: i.startswith("b"))
    return of


def plain(df):
    return df.withColumn("author", F.array_join("author", "; "))


def sql(kind: str) -> str:
    lost = "unfinished record" if kind == "t" else "unbalanced braces"
    ok = "p_partkey % 11 > 0 AND p_partkey % 13 > 0"
    title, author, form = ("p_name || ' of parts'", "'Doe, J.; ' || p_brand || ', K.'", "'JOUR'") if kind == "t" else ("p_name || ' of Parts'", "'Doe, J.; Roe, R.'", "'article'")
    values = {"id": f"'{kind}' || p_partkey", "type": form, "author": author, "year": "'19' || lpad((p_size % 100)::VARCHAR, 2, '0')", "title": title, "journal": "p_type", "pagination": "p_size || '-' || (p_size + 9)"}
    return "SELECT " + ", ".join(f"CASE WHEN {ok} THEN {v} END AS {c}" for c, v in values.items()) + f", CASE WHEN p_partkey % 11 = 0 THEN '{lost}' WHEN p_partkey % 13 = 0 THEN 'no title' END AS error FROM part"


SHOWN = ["id", "type", "author", "year", "title", "journal", "pagination", "error"]

QUERIES = {
    "s14_tagged": (lambda s, d: plain(tagged(s, d)).select(*SHOWN), sql("t")),
    "s14_braced": (lambda s, d: plain(braced(s, d)).select(*SHOWN), sql("b")),
    "s15_get": (lambda s, d: plain(registry(s, d).get("b5")).select("in", *SHOWN), f"SELECT 'braced' AS \"in\", * FROM ({sql('b')}) WHERE id = 'b5'"),
    "s15_find": (lambda s, d: plain(registry(s, d).find(author="Doe", year="1907", title="parts of")).select("in", *SHOWN), f"SELECT * FROM (SELECT 'tagged' AS \"in\", * FROM ({sql('t')}) UNION ALL SELECT 'braced', * FROM ({sql('b')})) WHERE error IS NULL AND year = '1907'"),
}
