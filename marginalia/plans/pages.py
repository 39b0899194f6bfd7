"""Queries on tables and page layout, over cells made from orders and lines made from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as ly
from ..operators import tables as tb
from ..session import table

C = F.col
#: Cells in SQL that both engines read: a hundred tables with a header row and four columns.
CELLS = """SELECT o_orderkey % 100 AS table_id, CAST(floor(o_orderkey / 100) + 1 AS INT) AS r, c, CASE c WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_orderkey AS VARCHAR(20)) WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR(20)) END ELSE CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR(20)) ELSE '' END END AS text
FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(c) UNION ALL SELECT DISTINCT o_orderkey % 100, 0, c, CASE c WHEN 0 THEN 'Name' WHEN 1 THEN 'Key no.' WHEN 2 THEN 'State' ELSE 'Note' END FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(c)"""
X = "x AS (" + CELLS.format(orders="orders") + ")"
#: Lines of pages, likewise.
LINES = "SELECT l_orderkey AS page, l_linenumber AS line, CAST(100 + (l_partkey % 3) * 10 AS INT) AS bl, CAST(500 - (l_suppkey % 5) * 20 AS INT) AS br, CAST(l_linenumber * 20 + floor(l_linenumber / 4) * 15 AS INT) AS bt, CAST(l_linenumber * 20 + floor(l_linenumber / 4) * 15 + 12 AS INT) AS bb FROM {lineitem}"
L = "l AS (" + LINES.format(lineitem="(SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)") + ")"
NUM = "regexp_matches(text, '^([0-9.,:;+\\-±%()\\s]*[0-9][0-9.,:;+\\-±%()\\s]*|[IVXLCDM]+)$')"


def cells(s, d):
    return s.sql(CELLS, orders=table(s, d, "orders"))


def lines(s, d):
    """One line for each (order, number): the first by part and supplier."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("k")).select("l_orderkey", "l_linenumber", "k.l_partkey", "k.l_suppkey")
    return s.sql(LINES, lineitem=li).select("page", "line", ly.box(C("bl"), C("br"), C("bt"), C("bb")).alias("box"))


def raw_cells(s, d):
    x = cells(s, d)
    return x.select(C("table_id").cast("long").alias("table_id"), F.when(C("r") == 0, "head").otherwise("body").alias("sec"), "r", C("c").alias("ord"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), "text")


def box():
    return C("box")


def shifted():
    return ly.moved(C("box"), F.lit(200), F.lit(5))


TYPES = f"y AS (SELECT table_id, r, CASE WHEN sum((length(text) > 0)::INT) = 0 THEN 'empty' WHEN sum((length(text) > 0 AND c > 0 AND {NUM})::INT) = 0 THEN 'header' ELSE 'data' END AS type FROM x GROUP BY 1, 2)"
HEADS = "h AS (SELECT table_id, c, text AS header, regexp_replace(text, '[^0-9A-Za-z\\-._]+', '_', 'g') AS name FROM x WHERE (table_id, r) IN (SELECT (table_id, min(r)) FROM y WHERE type = 'header' GROUP BY table_id))"
EXT = f"{X}, {TYPES}, {HEADS}, e AS (SELECT x.table_id, x.r, name, text, first_value(text) OVER (PARTITION BY x.table_id, x.r ORDER BY x.c) AS line, x.c FROM x JOIN y ON y.table_id = x.table_id AND y.r = x.r AND type = 'data' JOIN h ON h.table_id = x.table_id AND h.c = x.c)"


def island(breaks: str, part: str = "page") -> str:
    return f"sum(coalesce(({breaks})::INT, 0)) OVER (PARTITION BY {part} ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS para"


SHORT = f"s AS (SELECT *, br < avg(br) OVER w - 15 AND max(br) OVER w - min(br) OVER w >= 15 AS short FROM l WINDOW w AS (PARTITION BY page)), p AS (SELECT page, line, bl, br, {island('a')} FROM (SELECT *, lag(short) OVER (PARTITION BY page ORDER BY line) AS a FROM s))"
#: Strings on pages: page numbers with noise, one document a customer.
STR = "q AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS k FROM orders), u AS (SELECT doc, page, CASE k % 7 WHEN 0 THEN 'l' || (page % 10) WHEN 1 THEN 'abc' WHEN 2 THEN '0' || page ELSE CAST(page + 10 AS VARCHAR) END AS str FROM q)"


def strings(s, d):
    from pyspark.sql import Window

    q = table(s, d, "orders").select(C("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page"), C("o_orderkey").alias("k"))
    m = C("k") % 7
    return q.select("doc", "page", F.when(m == 0, F.concat(F.lit("l"), (C("page") % 10).cast("string"))).when(m == 1, "abc").when(m == 2, F.concat(F.lit("0"), C("page").cast("string"))).otherwise((C("page") + 10).cast("string")).alias("str"))


CAND = STR + ", d AS (SELECT doc, page, str, length(regexp_replace(str, '[0-9]', '', 'g'))::INT AS fuzzy, translate(str, 'lIiOoSBZg', '111005829')  AS n FROM u WHERE regexp_matches(translate(str, 'lIiOoSBZg', '111005829'), '^[1-9][0-9]{0,4}$') AND length(regexp_replace(str, '[0-9]', '', 'g')) < length(str))"
SCORE = CAND + """, g AS (SELECT *, n::INT AS value, n::INT - page AS diag FROM d), o AS (SELECT DISTINCT doc, diag, page FROM g), z AS (SELECT *, sum((coalesce(page - was, 0) > 3)::INT) OVER (PARTITION BY doc, diag ORDER BY page) AS run FROM (SELECT *, lag(page) OVER (PARTITION BY doc, diag ORDER BY page) AS was FROM o)),
sc AS (SELECT a.doc, a.diag, a.page, sum(abs(a.page - b.page))::BIGINT AS score FROM z a JOIN z b ON a.doc = b.doc AND a.diag = b.diag AND a.run = b.run GROUP BY 1, 2, 3), gs AS (SELECT doc, page, str, fuzzy, value, score FROM g JOIN sc USING (doc, diag, page))"""


def scored(s, d):
    return ly.sequence_scores(ly.page_candidates(strings(s, d)))


QUERIES = {
    "g1_grid": (lambda s, d: tb.grid(raw_cells(s, d)).select("table_id", "r", "c", "text"), f"WITH {X}, m AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY r) - 1 AS k FROM x) SELECT table_id::BIGINT AS table_id, k::INT AS r, c, text FROM m"),
    "g2_cells": (lambda s, d: cells(s, d).groupBy("table_id").agg(F.count_distinct("r").alias("rows"), F.count_distinct("c").alias("cols"), F.max(F.when((C("r") == 1) & (C("c") == 1), C("text"))).alias("one")), f"WITH {X} SELECT table_id, count(DISTINCT r) AS rows, count(DISTINCT c) AS cols, max(text) FILTER (WHERE r = 1 AND c = 1) AS one FROM x GROUP BY 1"),
    "g3_classify": (lambda s, d: tb.classify(cells(s, d)), f"WITH {X} SELECT table_id, CASE WHEN sum(({NUM})::INT) * 4 > count(*) * 3 THEN 'data' ELSE 'attribute' END AS type FROM x WHERE r > 0 AND c > 0 AND length(text) > 0 GROUP BY 1"),
    "g3_row_types": (lambda s, d: tb.row_types(cells(s, d)), f"WITH {X}, {TYPES} SELECT * FROM y"),
    "g4_orientation": (lambda s, d: tb.orientation(cells(s, d), s.createDataFrame([("Name", 5), ("State", 3), ("1-URGENT", 1)], "header string, n int")), f"WITH {X}, k AS (SELECT *, CASE text WHEN 'Name' THEN 5 WHEN 'State' THEN 3 WHEN '1-URGENT' THEN 1 ELSE 0 END AS n FROM x) SELECT table_id, CASE WHEN avg(n) FILTER (WHERE r = 0) >= avg(n) FILTER (WHERE c = 0) THEN 'row' ELSE 'column' END AS headers_in FROM k GROUP BY 1"),
    "g5_numeric": (lambda s, d: cells(s, d).select("table_id", "r", "c", tb.is_numeric(C("text")).alias("numeric")), f"WITH {X} SELECT table_id, r, c, {NUM} AS numeric FROM x"),
    "g6_headers": (lambda s, d: tb.headers(cells(s, d)), f"WITH {X}, {TYPES}, {HEADS} SELECT * FROM h"),
    "g7_extract": (lambda s, d: tb.extract(cells(s, d)), f"WITH {EXT} SELECT table_id, r, name, text, line FROM e WHERE c > 0"),
    "g8_abbreviations": (lambda s, d: tb.abbreviations(cells(s, d).filter("r < 2")).select("table_id", "key", C("values")["Key_no."].alias("no")), f"WITH {X} SELECT table_id, regexp_extract(max(text) FILTER (WHERE c = 0), '[\\p{{L}}0-9]+') AS key, max(text) FILTER (WHERE c = 1) AS no FROM x WHERE r = 1 GROUP BY 1"),
    "g9_append_rows": (lambda s, d: tb.append_rows(cells(s, d).filter("table_id < 50"), cells(s, d).filter("table_id < 60 AND r = 1")), f"WITH {X} SELECT table_id, r, c, text FROM x WHERE table_id < 50 UNION ALL SELECT table_id, (1 + (SELECT count(DISTINCT r) FROM x y WHERE y.table_id = x.table_id))::INT, c, text FROM x WHERE table_id < 50 AND r = 1"),
    "g8_abbreviations_all": (lambda s, d: tb.abbreviations(cells(s, d)).select("table_id", "r", "key", C("values")["Key_no."].alias("no")), f"WITH {EXT} SELECT table_id, r, regexp_extract(line, '[\\p{{L}}0-9]+') AS key, text AS no FROM e WHERE c = 1"),
    "g9_append_rows_all": (lambda s, d: tb.append_rows(*(cells(s, d).filter(C("r") % 2 == k) for k in (0, 1))), f"WITH {X} SELECT table_id, r, c, text FROM x WHERE r % 2 = 0 UNION ALL SELECT table_id, (r + (SELECT count(DISTINCT r) FROM x y WHERE y.table_id = x.table_id AND y.r % 2 = 0))::INT, c, text FROM x WHERE r % 2 = 1"),
    "g9_append_columns": (lambda s, d: tb.append_columns(cells(s, d), cells(s, d).filter("c < 2")), f"WITH {X} SELECT table_id, r, c, text FROM x UNION ALL SELECT table_id, r, c + 4, text FROM x WHERE c < 2"),
    "g10_preview": (lambda s, d: tb.preview(cells(s, d), 4, 2), f"WITH {X}, k AS (SELECT table_id, r, string_agg('<td>' || substr(text, 1, 4) || '</td>', '' ORDER BY c) AS t FROM x WHERE r < 2 GROUP BY 1, 2) SELECT table_id, string_agg('<tr>' || t || '</tr>', '' ORDER BY r) AS label FROM k GROUP BY 1"),
    "l1_boxes": (lambda s, d: lines(s, d).select("page", "line", ly.area(box()).alias("area"), ly.includes(box(), ly.scaled(box(), 1.0)).alias("self"), ly.includes(box(), shifted(), fuzzy=True).alias("centre"), ly.overlaps(box(), shifted()).alias("over"), ly.area(ly.union(box(), shifted())).alias("both"), ly.area(ly.intersect(box(), shifted())).alias("common")), f"WITH {L} SELECT page, line, (br - bl)::BIGINT * 12 AS area, true AS self, (bl + br) // 2 + 200 < br AS centre, bl + 200 < br AS over, (br + 200 - bl)::BIGINT * 17 AS both, CASE WHEN bl + 200 < br THEN (br - bl - 200)::BIGINT * 7 END AS common FROM l"),
    "l2_box_text": (lambda s, d: lines(s, d).select("page", "line", ly.to_text(box()).alias("text"), F.hex(ly.to_bytes(box())).alias("bytes")).withColumn("same", ly.to_text(ly.from_text(C("text"))) == C("text")), f"WITH {L} SELECT page, line, '[' || bl || ',' || br || ',' || bt || ',' || bb || ']' AS text, printf('%04X%04X%04X%04X', bl, br, bt, bb) AS bytes, true AS same FROM l"),
    "l3_merge_lines": (lambda s, d: ly.merge_side_by_side(lines(s, d).withColumn("box", F.when(C("line") % 2 == 0, ly.box(C("box.r") + 90, C("box.r") + 200, C("box.t") - 20, C("box.b") - 20)).otherwise(box())), ["page"]).groupBy("page").agg(F.count("*").alias("n")), f"WITH {L}, m AS (SELECT page, line, CASE WHEN line % 2 = 0 THEN br + 90 ELSE bl END AS a, CASE WHEN line % 2 = 0 THEN br + 200 ELSE br END AS b, bt - CASE WHEN line % 2 = 0 THEN 20 ELSE 0 END AS t FROM l), w AS (SELECT *, lag(b) OVER o AS pb, lag(t) OVER o AS pt FROM m WINDOW o AS (PARTITION BY page ORDER BY line)) SELECT page, sum((pb IS NULL OR NOT (12 - abs(t - pt) > 6 AND pb <= a))::INT)::BIGINT AS n FROM w GROUP BY 1"),
    "l4_short_lines": (lambda s, d: ly.split_short_lines(lines(s, d), ["page"], 300).select("page", "line", "para"), f"WITH {L}, {SHORT} SELECT page, line, para FROM p"),
    "l5_indents": (lambda s, d: ly.split_indents(lines(s, d), ["page"], 300).select("page", "line", "para"), f"WITH {L}, i AS (SELECT *, bl - min(bl) OVER w > 15 AS ind, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY page)), k AS (SELECT *, sum(ind::INT) OVER (PARTITION BY page) AS k FROM i) SELECT page, line, {island('CASE WHEN n < 4 THEN false WHEN k * 5 <= n * 2 THEN ind WHEN (n - k) * 5 <= n * 2 THEN NOT ind ELSE false END')} FROM k"),
    "l6_l7_gaps": (lambda s, d: ly.split_gaps(lines(s, d), ["page"]).select("page", "line", "para"), f"WITH {L}, g AS (SELECT *, bb - lag(bb) OVER (PARTITION BY page ORDER BY line) AS gap FROM l), m AS (SELECT *, avg(gap) OVER w AS a, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY page)) SELECT page, line, {island('gap >= a * 1.25 AND n >= 5')} FROM m"),
    "l8_paragraph_layout": (lambda s, d: ly.paragraph_layout(ly.split_short_lines(lines(s, d), ["page"], 300), ["page"], 300), f"WITH {L}, {SHORT}, f AS (SELECT *, row_number() OVER (PARTITION BY page, para ORDER BY line) = 1 AS f FROM p), a AS (SELECT page, para, arg_min(bl, line) AS l0, avg(bl) FILTER (WHERE NOT f) AS l1, coalesce(max(bl) FILTER (WHERE NOT f) - min(bl) FILTER (WHERE NOT f), 0) AS dl, max(br) - min(br) AS dr, max(bl + br) - min(bl + br) AS dc, count(*) AS n FROM f GROUP BY 1, 2) SELECT page, para, CASE WHEN dl <= 15 AND dr <= 15 THEN 'justified' WHEN dl <= 15 THEN 'left' WHEN dr <= 15 THEN 'right' WHEN dc <= 30 THEN 'center' ELSE 'left' END AS alignment, CASE WHEN n < 2 THEN 'none' WHEN l0 > l1 + 15 THEN 'indent' WHEN l0 < l1 - 15 THEN 'exdent' ELSE 'none' END AS indentation FROM a"),
    "l9_layout_vote": (lambda s, d: ly.vote(table(s, d, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag"), "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS l_returnflag FROM lineitem GROUP BY 1"),
    "l10_fill_layout": (lambda s, d: ly.fill_from_neighbours(table(s, d, "events").select("user_id", "event_id", F.when(C("event_type") != "view", C("event_type")).alias("layout")), ["user_id"], "event_id", "layout"), "WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'view' THEN event_type END AS y FROM events) SELECT user_id, event_id, coalesce(last_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), first_value(y IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS layout FROM e"),
    "l11_wrap": (lambda s, d: ly.wrap(lines(s, d), ["page"]).select("page", "box.*"), f"WITH {L} SELECT page, min(bl) AS l, max(br) AS r, min(bt) AS t, max(bb) AS b FROM l GROUP BY 1"),
    "l12_paragraphs": (lambda s, d: ly.split_paragraphs(lines(s, d), ["page"], 300).groupBy("page").agg(F.max("para").alias("n")), None),
    "i1_page_candidates": (lambda s, d: ly.page_candidates(strings(s, d)), f"WITH {CAND} SELECT doc, page, str, fuzzy, n::INT AS value FROM d"),
    "i2_sequence_scores": (scored, f"WITH {SCORE} SELECT * FROM gs"),
    "i3_repair_numbers": (lambda s, d: ly.repair_numbers(ly.best_per_page(scored(s, d))), None),
    "i4_i5_best_per_page": (lambda s, d: ly.best_per_page(scored(s, d)), f"WITH {SCORE} SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY score / (fuzzy + 1) DESC, fuzzy, value) = 1"),
    "i6_page_ranges": (lambda s, d: ly.page_ranges(strings(s, d).filter("str <> 'abc'")), f"WITH {STR}, r AS (SELECT doc, page, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS g FROM u WHERE str <> 'abc'), k AS (SELECT doc, min(page) AS a, max(page) AS b FROM r GROUP BY doc, g) SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM k GROUP BY 1"),
}
