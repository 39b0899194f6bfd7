"""Queries on lines, paragraphs and page numbers, over lines made from lineitem and tokens made from orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import layout as ly
from ..operators import paragraphs as pg
from ..session import table
from .pages import L, lines

C = F.col


def fragments(s, d):
    """Each line cut in up to three fragments, told in an order that isn't that of reading."""
    cut = lambda k: ly.box(C("box.l") + (C("box.r") - C("box.l")) * k / 3 + 2, C("box.l") + (C("box.r") - C("box.l")) * (k + 1) / 3 - 2, C("box.t") + k, C("box.b") + k)
    parts = F.array(*(F.struct(F.lit((k * 2) % 3).alias("k"), cut(k).alias("box")) for k in range(3)))
    one = lines(s, d).select("page", "line", F.explode(F.slice(parts, 1, (C("line") % 3 + 1).cast("int"))).alias("p"))
    return one.select("page", (C("line") * 10 + C("p.k")).alias("line"), C("p.box").alias("box"), (C("line") % 2 * 100).alias("baseline"))


#: Blocks of up to a hundred lines, of seven pages each.
BLOCK = "b AS (SELECT page // 28 AS block, page * 10 + line AS line, bl, br, row_number() OVER (PARTITION BY page // 28 ORDER BY page, line) AS k FROM l), o AS (SELECT block, line, bl, br, (k * 20 + k // 3 * 5 + k // 8 * 30)::INT AS bt, (k * 20 + k // 3 * 5 + k // 8 * 30 + 12 - CASE WHEN k % 11 = 0 THEN 8 ELSE 0 END)::INT AS bb, (k // (5 + block % 12 * 3))::BIGINT AS para FROM b)"


def blocks(s, d):
    k = F.row_number().over(Window.partitionBy("block").orderBy("page", "line"))
    rows = lines(s, d).withColumn("block", F.floor(C("page") / 28)).withColumn("k", k)
    top = C("k") * 20 + F.floor(C("k") / 3) * 5 + F.floor(C("k") / 8) * 30
    boxed = ly.box(C("box.l"), C("box.r"), top, top + 12 - F.when(C("k") % 11 == 0, 8).otherwise(0))
    return rows.select("block", (C("page") * 10 + C("line")).alias("line"), boxed.alias("box"), F.floor(C("k") / (5 + C("block") % 12 * 3)).cast("long").alias("para"))


def island(split: str) -> str:
    return f"sum((coalesce(lag_para <> para, false) OR coalesce({split}, false))::INT) OVER (PARTITION BY block ORDER BY line ROWS UNBOUNDED PRECEDING)::BIGINT AS para"


STARTS = f"""WITH {L}, {BLOCK}, a AS (SELECT *, bl - min(bl) OVER w AS s, max(br) OVER w - min(bl) OVER w AS wide, (bb - bt) * 2 >= (sum(bb - bt) OVER w // count(*) OVER w) // 2 * 2 AS tall, row_number() OVER (PARTITION BY block, para ORDER BY line) = 1 AS f, count(*) OVER (PARTITION BY block, para) AS n, lag(para) OVER (PARTITION BY block ORDER BY line) AS lag_para FROM o WINDOW w AS (PARTITION BY block)),
c AS (SELECT *, tall AND s * 3 <= wide AS counts FROM a),
m AS (SELECT *, min(s) FILTER (counts) OVER w AS lo, max(s) FILTER (counts) OVER w AS hi, coalesce(sum(s) FILTER (counts) OVER w // nullif(count(*) FILTER (counts) OVER w, 0), 0) AS mean, coalesce(sum(s) FILTER (counts AND f) OVER w // nullif(count(*) FILTER (counts AND f) OVER w, 0), 0) AS mean_first, sum(f::INT) OVER w AS paras FROM c WINDOW w AS (PARTITION BY block)),
r AS (SELECT *, abs(s - hi) < abs(s - lo) AS rgt FROM m), k AS (SELECT *, sum((tall AND rgt)::INT) OVER w AS rs, sum((tall AND NOT rgt)::INT) OVER w AS ls FROM r WINDOW w AS (PARTITION BY block))
SELECT block, line, {island("NOT f AND hi - lo >= 15 AND CASE WHEN paras >= 3 THEN abs(s - mean) > abs(s - mean_first) WHEN n < 4 THEN false WHEN n < 10 THEN CASE WHEN rgt THEN rs * 2 <= ls ELSE ls * 2 <= rs END WHEN rgt THEN rs * 3 <= ls * 2 ELSE ls * 3 <= rs * 2 END")} FROM k"""
MARGINS = f"""WITH {L}, {BLOCK}, a AS (SELECT *, row_number() OVER q = 1 AS f, max(bb) OVER (PARTITION BY block, para) AS bottom, min(bt) OVER (PARTITION BY block, para) AS top, lag(para) OVER (PARTITION BY block ORDER BY line) AS lag_para FROM o WINDOW q AS (PARTITION BY block, para ORDER BY line)),
g AS (SELECT *, bt - lag(bb) OVER w AS gap, CASE WHEN f THEN top - lag(bottom) OVER w END AS between_ FROM a WINDOW w AS (PARTITION BY block ORDER BY line)),
m AS (SELECT *, coalesce(trunc(avg(gap) OVER w)::INT, 0) AS lm, coalesce(trunc(avg(between_) OVER w)::INT, 0) AS pm, sum(f::INT) OVER w AS paras FROM g WINDOW w AS (PARTITION BY block))
SELECT block, line, {island("NOT f AND paras >= 3 AND abs(gap - lm) > abs(gap - pm) AND greatest(15, lm * 3 // 2) < gap")} FROM m"""


def tokens(s, d):
    """Tokens of pages, a document for each customer: numbers as they are and as they are misread, at the edges and in the middle."""
    q = table(s, d, "orders").select(C("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page"), C("o_orderkey").alias("k"))
    m, own = C("k") % 8, (C("page") + 10).cast("string")
    text = F.when(m == 0, F.translate(own, "15", "lS")).when(m == 1, F.translate(own, "128", "lZB")).when(m == 2, F.concat(F.lit("O"), own)).when(m == 3, "word").when(m == 4, F.concat(F.lit("0"), own)).when(m == 5, F.concat(own, F.lit("0000"))).otherwise(own)
    return q.select("doc", "page", (C("k") % 90).alias("pos"), F.lit(90).cast("long").alias("size"), text.alias("str"), (C("k") % 5 > 0).alias("ocred"))


READ = f"""WITH RECURSIVE q AS (SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey AS k FROM orders),
u AS (SELECT doc, page, k % 90 AS pos, k % 5 > 0 AS ocred, CASE k % 8 WHEN 0 THEN translate((page + 10)::VARCHAR, '15', 'lS') WHEN 1 THEN translate((page + 10)::VARCHAR, '128', 'lZB') WHEN 2 THEN 'O' || (page + 10) WHEN 3 THEN 'word' WHEN 4 THEN '0' || (page + 10) WHEN 5 THEN (page + 10) || '0000' ELSE (page + 10)::VARCHAR END AS str FROM q),
t AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{v}')" for c, v in pg.READINGS.items())}) AS v(c, d)),
e AS (SELECT doc, page, pos, str, ocred, 0 AS i, '' AS v, 0 AS fuzzy, 1 AS ambiguity FROM u WHERE (pos <= 25 OR pos + 1 >= 65) AND length(str) BETWEEN 1 AND 5 AND (ocred OR regexp_matches(str, '^[0-9]+$'))
  UNION ALL SELECT doc, page, pos, str, ocred, i + 1, v || x.digit, fuzzy + (ocred AND length(t.d) > 1)::INT, ambiguity * CASE WHEN ocred THEN length(t.d) ELSE 1 END FROM e JOIN t ON t.c = str[i + 1], unnest(CASE WHEN ocred THEN str_split(t.d, '') ELSE [str[i + 1]] END) AS x(digit) WHERE i < length(str)),
c AS (SELECT doc, page, pos, str, fuzzy::INT AS fuzzy, ambiguity::INT AS ambiguity, v::INT AS value FROM e WHERE i = length(str) AND v[1] <> '0')"""
SCORED = READ + """, o AS (SELECT DISTINCT doc, value - page AS diag, page FROM c), z AS (SELECT *, sum((coalesce(page - was, 0) > 3)::INT) OVER (PARTITION BY doc, diag ORDER BY page) AS run FROM (SELECT *, lag(page) OVER (PARTITION BY doc, diag ORDER BY page) AS was FROM o)),
sc AS (SELECT a.doc, a.diag, a.page, sum(abs(a.page - b.page))::BIGINT AS score FROM z a JOIN z b ON a.doc = b.doc AND a.diag = b.diag AND a.run = b.run GROUP BY 1, 2, 3), g AS (SELECT c.*, score FROM c JOIN sc ON sc.doc = c.doc AND sc.page = c.page AND sc.diag = value - c.page)"""

QUERIES = {
    "l3_fragments": (lambda s, d: pg.merge_fragments(fragments(s, d), ["page"]).select("page", "line", "box.*", "baseline"), f"WITH {L}, f AS (SELECT page, line, bl, least(line % 3 + 1, 3) AS n, br - bl AS w, bt, bb FROM l) SELECT page, row_number() OVER (PARTITION BY page ORDER BY line)::INT AS line, bl + 2 AS l, floor(bl + w * n / 3 - 2)::INT AS r, bt AS t, (bb + n - 1)::INT AS b, (line % 2 * 100)::INT AS baseline FROM f"),
    "l5_starts": (lambda s, d: pg.split_starts(blocks(s, d), ["block"], 300).select("block", "line", "para"), STARTS),
    "l6_margins": (lambda s, d: pg.split_margins(blocks(s, d), ["block"], 300).select("block", "line", "para"), MARGINS),
    "i1_readings": (lambda s, d: pg.page_readings(tokens(s, d)), READ + " SELECT * FROM c"),
    "i4_best_readings": (lambda s, d: pg.best_readings(ly.sequence_scores(pg.page_readings(tokens(s, d)))), SCORED + " SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc, page ORDER BY score // (fuzzy + ambiguity) DESC, fuzzy + ambiguity, value, pos) = 1"),
}
