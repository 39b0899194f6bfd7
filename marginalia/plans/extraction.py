"""Queries on extraction from tables, over cells made from orders: a header row, an attribute column, and an attribute row in ten."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as ex
from .pages import NUM, X, cells

C = F.col


def extracted(s, d):
    of = cells(s, d)
    rows = of.select("table_id", "r").distinct().withColumn("type", F.when(C("r") == 0, "header").when(C("r") % 10 == 5, "attribute").otherwise("data"))
    columns = of.select("table_id", "c").distinct().withColumn("type", F.when(C("c") == 0, "attribute").otherwise("data"))
    told = ex.extract(of, rows, columns)
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return told.select("table_id", "r", "c", "value", "header", "name", F.array_join(pairs, ";").alias("attributes"))


CLEAN = "regexp_replace(trim({}), '[^0-9A-Za-z\\-._]', '_', 'g')"
EXTRACTED = f"""WITH {X}, t AS (SELECT table_id, r, c, nullif(trim(text), '') AS text FROM x),
d AS (SELECT * FROM t WHERE r > 0 AND r % 10 <> 5 AND c > 0 AND text IS NOT NULL), h AS (SELECT table_id, c, text FROM t WHERE r = 0),
a AS (SELECT v.table_id, v.r, v.c, v.text, {CLEAN.format("n.text")} AS name FROM t v JOIN t n ON n.table_id = v.table_id AND n.r = v.r AND n.c = 0 WHERE v.r % 10 = 5 AND v.c > 0 AND v.text IS NOT NULL),
o AS (SELECT d.table_id, d.r, d.c, a.name, arg_max(a.text, a.r) AS text FROM d JOIN a ON a.table_id = d.table_id AND a.c = d.c AND a.r < d.r GROUP BY ALL),
e AS (SELECT table_id, r, c, name || '=' || text AS pair FROM o UNION ALL SELECT d.table_id, d.r, d.c, 'Name=' || p.text FROM d JOIN t p ON p.table_id = d.table_id AND p.r = d.r AND p.c = 0),
g AS (SELECT table_id, r, c, string_agg(pair, ';' ORDER BY pair) AS attributes FROM e GROUP BY ALL)
SELECT d.table_id, d.r, d.c, d.text AS value, h.text AS header, {CLEAN.format("h.text")} AS name, coalesce(attributes, '') AS attributes FROM d JOIN h ON h.table_id = d.table_id AND h.c = d.c LEFT JOIN g ON g.table_id = d.table_id AND g.r = d.r AND g.c = d.c"""

QUERIES = {
    "g6_g7_inherited": (extracted, EXTRACTED),
    "g3_line_types": (lambda s, d: ex.line_types(cells(s, d)), f"WITH {X}, k AS (SELECT table_id, r, sum((length(trim(text)) > 0)::INT) AS n, sum((length(trim(text)) > 0 AND c > 0 AND {NUM})::INT) AS k FROM x GROUP BY 1, 2) SELECT table_id, r, CASE WHEN n = 0 THEN 'empty' WHEN k > 0 THEN 'data' WHEN max((k > 0)::INT) OVER (PARTITION BY table_id ORDER BY r) = 0 THEN 'header' ELSE 'attribute' END AS type FROM k"),
}
