"""Queries on dates, over sentences that are rendered from orders' dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dates as dt
from ..operators import tokens as tk
from ..session import table

C = F.col
D, M, Y = "day(o_orderdate)", "month(o_orderdate)", "year(o_orderdate)"


def _list(i: int) -> str:
    return " ".join(f"WHEN {m} THEN '{dt.MONTHS[m].split()[i]}'" for m in dt.MONTHS)


ROMAN = " ".join(f"WHEN {m} THEN '{r}'" for m, r in enumerate("i ii iii iv v vi vii viii ix x xi xii".split(), 1))
NAME = f"CASE WHEN o_orderkey % 2 = 0 THEN (CASE {M} {_list(0)} END) ELSE (CASE {M} {_list(-1)} END) END"
TEXT = f"""SELECT o_orderkey AS doc_id, o_orderdate, CASE o_orderkey % 6 WHEN 0 THEN 'seen ' || {D} || '. ' || {NAME} || ' ' || {Y} || ' here' WHEN 1 THEN 'seen ' || {NAME} || ' ' || {D} || ', ' || {Y}
WHEN 2 THEN {Y} || '-' || lpad(CAST({M} AS VARCHAR(9)), 2, '0') || '-' || lpad(CAST({D} AS VARCHAR(9)), 2, '0') WHEN 3 THEN 'on ' || {D} || '.' || (CASE {M} {ROMAN} END) || '.' || {Y} WHEN 4 THEN {Y} || ', ' || {D} || ' ' || {NAME} ELSE 'in ' || {NAME} || ' ' || {Y} END AS text,
'from ' || {NAME} || ' ' || (5 + o_orderkey % 4) || ' - ' || (5 + o_orderkey % 9) || ' and ' || (o_orderkey % 9 + 1) || ', ' || (o_orderkey % 9 + 3) || ' und ' || (o_orderkey % 9 + 7) || ' ' || {NAME} || ' ' || {Y} AS listed FROM {{orders}}"""
T = "t AS (" + TEXT.format(orders="orders") + ")"


def texts(s, d):
    return s.sql(TEXT, orders=table(s, d, "orders"))


def toks(s, d):
    return tk.tokens(texts(s, d))


def listed(s, d):
    return tk.tokens(texts(s, d), text="listed")


END = "CAST(o_orderdate AS DATE) + INTERVAL 20 DAY"
D2, M2 = f"day({END})", f"month({END})"
MONTH = "(CASE {0} " + _list(0) + " END)"
#: Ranges of days in a month and over two months, months before days and after, and the two orders that put the year in the middle; months in a list.
MORE = f"""SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'seen ' || {D} || ' ' || {MONTH.format(M)} || ' - ' || {D2} || ' ' || {MONTH.format(M2)} || ' ' || {Y} WHEN 1 THEN 'seen ' || {MONTH.format(M)} || ' 7 to 19, ' || {Y} WHEN 2 THEN '3rd-9th ' || {MONTH.format(M)} || ' ' || {Y}
WHEN 3 THEN {MONTH.format(M)} || ' ' || {Y} || ' ' || {D} || ' here' WHEN 4 THEN {D} || ' ' || {Y} || ' ' || {MONTH.format(M)} ELSE {MONTH.format(M)} || ' ' || {D} || ' - ' || {MONTH.format(M2)} || ' ' || {D2} || ', ' || {Y} END AS text,
'in ' || (CASE 1 + o_orderkey % 4 {_list(0)} END) || ', ' || (CASE 6 + o_orderkey % 2 {_list(0)} END) || ' and ' || (CASE 9 + o_orderkey % 4 {_list(0)} END) || ' ' || {Y} AS months, o_orderdate FROM {{orders}} WHERE {M} < 12"""
M3 = "u AS (" + MORE.format(orders="orders") + ")"


def more(s, d, text="text"):
    return tk.tokens(s.sql(MORE, orders=table(s, d, "orders")), text=text)


def several(s, d):
    t = toks(s, d)
    two = dt.partial(t, "my").withColumn("year_len", F.lit(4)).unionByName(dt.partial(t, "dm").withColumn("year_len", F.lit(0)))
    return dt.dates(t).select("doc_id", "start", "end", "value", "year_len").unionByName(two.drop("said"))


ISO = "strftime(o_orderdate, '%Y-%m-%d')"


def shared(s, d):
    t = listed(s, d)
    days = dt.enumerations(dt.parts(t, "d"), t)
    my = dt.partial(t, "my").withColumn("value", C("value"))
    return dt.shared(days, my).select("doc_id", "value")


QUERIES = {
    "t1_months": (lambda s, d: dt.parts(toks(s, d).filter(~C("tok").rlike("^[0-9]")), "m").select("doc_id", "value"), f"WITH {T} SELECT doc_id, lpad(month(o_orderdate)::VARCHAR, 2, '0') AS value FROM t WHERE doc_id % 6 <> 2"),
    "t1_days": (lambda s, d: dt.parts(toks(s, d), "d").filter("said NOT LIKE '0%'").groupBy("doc_id").agg(F.max("value").alias("value")), f"WITH {T}, n AS (SELECT doc_id, day(o_orderdate) AS d, month(o_orderdate) AS m FROM t WHERE doc_id % 6 <> 5) SELECT doc_id, lpad((CASE WHEN doc_id % 6 <> 2 THEN d WHEN d > 9 THEN greatest(d, CASE WHEN m > 9 THEN m ELSE 0 END) ELSE m END)::VARCHAR, 2, '0') AS value FROM n WHERE doc_id % 6 <> 2 OR d > 9 OR m > 9"),
    "t2_years": (lambda s, d: table(s, d, "orders").select("o_orderkey", dt.year_value(F.date_format("o_orderdate", "yy"), 1997, F.lit(True)).alias("two"), dt.year_value(F.date_format("o_orderdate", "yyyy"), 1997).alias("four")), "WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, (y % 100 + 100 * greatest(0, ceil((1997 - y % 100) / 100.0)::INT - 1))::VARCHAR AS two, y::VARCHAR AS four FROM y"),
    "t3_ranges": (lambda s, d: dt.ranges(dt.parts(listed(s, d), "d"), listed(s, d)).select("doc_id", "value", "value_max"), f"WITH {T} SELECT doc_id, lpad((5 + doc_id % 4)::VARCHAR, 2, '0') AS value, lpad((5 + doc_id % 9)::VARCHAR, 2, '0') AS value_max FROM t WHERE doc_id % 4 < doc_id % 9"),
    "t4_enumerations": (lambda s, d: dt.enumerations(dt.parts(listed(s, d), "d"), listed(s, d)).select("doc_id", F.array_join("values", ",").alias("days")), f"WITH {T}, n AS (SELECT doc_id, 5 + doc_id % 9 AS a, doc_id % 9 + 1 AS b, doc_id % 9 + 3 AS c, doc_id % 9 + 7 AS e FROM t) SELECT doc_id, array_to_string(list_transform([b, c, e], lambda x: lpad(x::VARCHAR, 2, '0')), ',') AS days FROM n"),
    "t5_day_month_ranges": (lambda s, d: dt.ranges(dt.parts(listed(s, d), "d"), listed(s, d)).join(dt.parts(listed(s, d).filter(~C("tok").rlike("^[0-9]")), "m").select("doc_id", C("end").alias("start"), C("value").alias("month")), ["doc_id", "start"]).select("doc_id", F.concat_ws("-", "month", "value").alias("value"), F.concat_ws("-", "month", "value_max").alias("value_max")), f"WITH {T} SELECT doc_id, strftime(o_orderdate, '%m') || '-' || lpad((5 + doc_id % 4)::VARCHAR, 2, '0') AS value, strftime(o_orderdate, '%m') || '-' || lpad((5 + doc_id % 9)::VARCHAR, 2, '0') AS value_max FROM t WHERE doc_id % 4 < doc_id % 9"),
    "t6_pairs": (lambda s, d: dt.pairs(dt.parts(toks(s, d), "d"), dt.parts(toks(s, d).filter(~C("tok").rlike("^[0-9]")), "m"), toks(s, d)).select("doc_id", "a", "b", "bridge"), f"WITH {T} SELECT doc_id, lpad(day(o_orderdate)::VARCHAR, 2, '0') AS a, lpad(month(o_orderdate)::VARCHAR, 2, '0') AS b, CASE WHEN doc_id % 6 = 4 THEN '' ELSE '.' END AS bridge FROM t WHERE doc_id % 6 IN (0, 3, 4)"),
    "t7_t8_dates": (lambda s, d: dt.dates(toks(s, d)).select("doc_id", "value", "parts"), f"WITH {T} SELECT doc_id, {ISO} AS value, (['dmy', 'mdy', 'ymd', 'dmy', 'ydm'])[doc_id % 6 + 1] AS parts FROM t WHERE doc_id % 6 < 5"),
    "t5_t7_ranged_dates": (lambda s, d: dt.dates(more(s, d)).select("doc_id", "value", "value_max", "parts"), f"""WITH {M3}, n AS (SELECT doc_id, o_orderdate, CASE doc_id % 6 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE {D} END AS d1, CASE doc_id % 6 WHEN 1 THEN 19 WHEN 2 THEN 9 ELSE {D2} END AS d2, CASE WHEN doc_id % 6 IN (0, 5) THEN {M2} ELSE {M} END AS m2 FROM u)
SELECT doc_id, CASE WHEN {M} < m2 OR doc_id % 6 NOT IN (0, 5) THEN {Y} || '-' || lpad({M}::VARCHAR, 2, '0') || '-' || lpad(d1::VARCHAR, 2, '0') ELSE {Y} || '-' || lpad(m2::VARCHAR, 2, '0') || '-' || lpad(d2::VARCHAR, 2, '0') END AS value,
CASE WHEN doc_id % 6 IN (1, 2) OR doc_id % 6 IN (0, 5) AND {M} < m2 THEN {Y} || '-' || lpad(m2::VARCHAR, 2, '0') || '-' || lpad(d2::VARCHAR, 2, '0') END AS value_max, (['dmy', 'mdy', 'dmy', 'myd', 'dym', 'mdy'])[doc_id % 6 + 1] AS parts FROM n"""),
    "t9_by_year": (lambda s, d: dt.resolve_by_year(several(s, d)).select("doc_id", "value"), f"WITH {T} SELECT doc_id, {ISO} AS value FROM t WHERE doc_id % 6 < 5 UNION ALL SELECT doc_id, strftime(o_orderdate, '%Y-%m') FROM t WHERE doc_id % 6 IN (0, 3, 5)"),
    "t10_shared_months": (lambda s, d: dt.shared(dt.enumerations(dt.parts(more(s, d, "months").filter(~C("tok").rlike("^[0-9]")), "m"), more(s, d, "months")), dt.parts(more(s, d, "months"), "y")).select("doc_id", "value"), f"WITH {M3} SELECT doc_id, {Y} || '-' || lpad(unnest([1 + doc_id % 4, 6 + doc_id % 2, 9 + doc_id % 4])::VARCHAR, 2, '0') AS value FROM u"),
    "t14_year_ranges": (lambda s, d: table(s, d, "orders").select("o_orderkey", dt.year_range(F.concat(F.year("o_orderdate").cast("string"), F.lit("\u2013"), (F.col("o_orderkey") % 100).cast("string"))).alias("r")).select("o_orderkey", "r.*"), "WITH n AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y, (o_orderkey % 100)::VARCHAR AS k FROM orders), w AS (SELECT o_orderkey, y, substr(y, 1, 4 - length(k)::INT) || k AS z FROM n) SELECT o_orderkey, CASE WHEN y < z THEN y END AS value_min, CASE WHEN y < z THEN z END AS value_max FROM w"),
    "t16_vote": (lambda s, d: dt.frequent_shapes(several(s, d).withColumn("said", C("value"))).select("doc_id", "value"), f"WITH {T} SELECT doc_id, {ISO} AS value FROM t WHERE doc_id % 6 IN (0, 1, 2, 4) UNION ALL SELECT doc_id, strftime(o_orderdate, '%m-%d') FROM t WHERE doc_id % 6 IN (3, 4) UNION ALL SELECT doc_id, strftime(o_orderdate, '%Y-%m') FROM t WHERE doc_id % 6 IN (0, 3, 5)"),
    "t9_resolved": (lambda s, d: dt.resolve(dt.dates(toks(s, d)).select("doc_id", "start", "end", "value").unionByName(dt.partial(toks(s, d), "my").drop("said"))).select("doc_id", "value"), f"WITH {T} SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN strftime(o_orderdate, '%Y-%m') ELSE {ISO} END AS value FROM t"),
    "t10_shared_year": (shared, f"WITH {T} SELECT doc_id, strftime(o_orderdate, '%Y-%m-') || lpad(unnest([doc_id % 9 + 1, doc_id % 9 + 3, doc_id % 9 + 7])::VARCHAR, 2, '0') AS value FROM t"),
    "t11_partial": (lambda s, d: dt.partial(toks(s, d), "my").select("doc_id", "value"), f"WITH {T} SELECT doc_id, strftime(o_orderdate, '%Y-%m') AS value FROM t WHERE doc_id % 6 IN (0, 3, 5)"),
    "t12_month_bounds": (lambda s, d: table(s, d, "orders").select("o_orderkey", dt.month_bounds(F.year("o_orderdate"), F.lit(2), F.month("o_orderdate")).alias("b")).select("o_orderkey", "b.*"), "SELECT o_orderkey, year(o_orderdate) || '-02-01' AS value_min, last_day(o_orderdate::DATE)::VARCHAR AS value_max FROM orders"),
    "t13_masked": (lambda s, d: table(s, d, "orders").select("o_orderkey", dt.by_mask(F.date_format("o_orderdate", "ddMMyyyy"), "ddmmyyyy").alias("a"), dt.by_mask(F.date_format("o_orderdate", "yyyy/MM"), "yyyy/mm").alias("b")), f"SELECT o_orderkey, {ISO} AS a, strftime(o_orderdate, '%Y-%m') || '-00' AS b FROM orders"),
    "t14_year_lists": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(dt.year_list(F.concat(F.year("o_orderdate").cast("string"), F.lit(", 99 and 8"))), ",").alias("years")), "SELECT o_orderkey, year(o_orderdate) || ',' || substr(year(o_orderdate)::VARCHAR, 1, 2) || '99,' || substr(year(o_orderdate)::VARCHAR, 1, 3) || '8' AS years FROM orders"),
    "t15_without_numbers": (lambda s, d: dt.without_numbers(dt.parts(toks(s, d), "y").unionByName(dt.parts(toks(s, d), "d")), toks(s, d), ("here",)).select("doc_id", "value"), f"WITH {T} SELECT doc_id, year(o_orderdate)::VARCHAR AS value FROM t WHERE doc_id % 6 > 0"),
    "t16_shapes": (lambda s, d: texts(s, d).select("doc_id", dt.shape(C("text")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n")), f"WITH {T} SELECT regexp_replace(regexp_replace(regexp_replace(text, '\\p{{Lu}}+', 'A', 'g'), '\\p{{Ll}}+', 'a', 'g'), '[0-9]+', '1', 'g') AS shape, count(*) AS n FROM t GROUP BY 1"),
}
