"""Queries on tokens, spans and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import termstats as ts
from ..operators import tokens as tk
from ..session import table

TOK = r"[\p{L}\p{M}]+|[0-9]+|[^\s\p{L}\p{M}0-9]"
SQL_TOKENS = f"t AS (SELECT doc_id, regexp_extract_all(text, '{TOK}') AS a FROM documents), tok AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS tok FROM t)"
#: Names like those of serials: words, a bracketed brand, a type after a comma.
NAMES = "concat(p_name, ' (', p_brand, '), ', lower(p_type), ' ', p_name)"
SQL_NAMES = f"t AS (SELECT p_partkey AS doc_id, regexp_extract_all(p_name || ' (' || p_brand || '), ' || lower(p_type) || ' ' || p_name, '{TOK}') AS a FROM part), tok AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS tok FROM t)"
SQL_POS = SQL_NAMES + ", p AS (SELECT doc_id, pos, tok, lower(tok) AS term, lead(lower(tok)) OVER w AS next, sum(CASE WHEN tok IN ('(', '[') THEN 1 WHEN tok IN (')', ']') THEN -1 ELSE 0 END) OVER w AS depth, lag(tok) OVER w = ',' AS after_comma FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
_family = ", ".join(f"n_{x}, n_{x} / n AS {x}_norm, CASE WHEN n_{x} > 0 THEN n_{x} / n ELSE 0.5 / n END AS {x}_smooth" for x in ("start", "end", "bracket", "comma"))


def docs(spark, sf):
    return table(spark, sf, "documents")


def names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(NAMES).alias("text"))


def positions(spark, sf):
    return ts.with_positions(tk.tokens(names(spark, sf)))


def spans(spark, sf, pattern):
    return tk.window_spans(docs(spark, sf), pattern, 1)


def profile(spark, sf):
    """Flagship: per language and term, its count, share, share of sentence starts and most frequent successor."""
    terms = docs(spark, sf).select("lang", F.transform(tk.token_array(F.col("text")), F.lower).alias("terms"))
    t = ts.successions(terms, "terms")
    p = t.groupBy("lang", "term", "next").agg(F.count("*").alias("c"), F.sum((F.col("pos") == 0).cast("long")).alias("s"))
    best = p.groupBy("lang", "term").agg(F.sum("c").alias("n"), F.sum("s").alias("n_start"), F.min_by("next", F.when(F.col("next").isNotNull(), F.struct(-F.col("c"), F.col("next")))).alias("successor"))
    whole = terms.groupBy("lang").agg(F.sum(F.size("terms")).alias("total"))  # from the texts, as counts of pairs would be shuffled again
    return best.join(whole, "lang").select("lang", "term", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"), F.round(F.col("n_start") / F.col("n"), 9).alias("start_share"), "successor")


CAP = r"^\p{Lu}\p{Ll}+$"
LOW = r"^\p{Ll}+$"
ABBR = "VALUES ('j', 'journal', 5), ('j', 'jour', 2), ('jour', 'journal', 4), ('zool', 'zoology', 3), ('zoology', 'zoological', 1), ('zoological', 'z', 1)"


def abbreviations(spark, sf):
    """Edges between short and full forms: market segments by their prefixes of 3 and 6 letters, with the number of customers."""
    c = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("s"))
    a = c.groupBy(F.substring("s", 1, 3).alias("short"), F.substring("s", 1, 6).alias("form")).agg(F.count("*").alias("n"))
    b = c.groupBy(F.substring("s", 1, 6).alias("short"), F.col("s").alias("form")).agg(F.count("*").alias("n"))
    return a.unionByName(b).filter("short <> form")


SQL_ABBR = "s AS (SELECT lower(c_mktsegment) AS s FROM customer), e AS (SELECT * FROM (SELECT substr(s, 1, 3) AS short, substr(s, 1, 6) AS form, count(*) AS n FROM s GROUP BY 1, 2 UNION ALL SELECT substr(s, 1, 6), s, count(*) FROM s GROUP BY 1, 2) WHERE short <> form)"
SQL_CLOSURE = SQL_ABBR + ", c(short, form, dist) AS (SELECT short, form, 1 FROM e UNION ALL SELECT c.short, e.form, dist + 1 FROM c JOIN e ON e.short = c.form WHERE dist < 16 AND e.form <> c.short)"
FLAGS = "f AS (SELECT s AS form, bool_or(substr(s, 1, 1) < 'c') AS flag FROM (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer) GROUP BY 1)"


def inherited(spark, sf):
    """Terms that are flagged themselves or over a full form."""
    e = abbreviations(spark, sf)
    f = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("form")).distinct().withColumn("flag", F.substring("form", 1, 1) < "c")
    return ts.closure(e).join(f, "form").groupBy("short").agg(F.bool_or("flag").alias("flag"))


def stops(spark, sf):
    t = tk.tokens(docs(spark, sf))
    c = t.groupBy(F.lower("tok").alias("term")).agg(F.count("*").alias("n"), F.sum((F.col("tok") == F.lower("tok")).cast("long")).alias("stop"))
    return ts.stop_words(c)


def mixed_terms(spark, sf):
    """The first one to three tokens of each item."""
    t = table(spark, sf, "benchmark").select("item_id", tk.token_array(F.col("text")).alias("t")).filter(F.size("t") >= 3)
    return t.select(F.array_join(F.slice("t", F.lit(1), (F.col("item_id") % 3 + 1).cast("int")), " ").alias("term"))


def first_terms(spark, sf):
    grams = tk.window_spans(table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "", 2).filter("start = 0")
    return grams.select(F.lower("value").alias("term")).distinct()


def lines(spark, sf):
    p = positions(spark, sf)
    return ts.to_lines(p.groupBy("term").agg(F.count("*").alias("n")), ts.successors(p))


QUERIES = {
    "k1_tokenise": (lambda s, d: tk.tokens(docs(s, d)), f"WITH {SQL_TOKENS} SELECT doc_id, pos::INT AS pos, tok FROM tok"),
    "k2_window_matches": (lambda s, d: tk.window_spans(docs(s, d), r"^\p{Lu}\p{Ll}+ \p{Ll}+$", 2), f"WITH {SQL_TOKENS}, w AS (SELECT doc_id, pos AS start, pos + 2 AS \"end\", tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS value FROM tok) SELECT * FROM w WHERE regexp_matches(value, '^\\p{{Lu}}\\p{{Ll}}+ \\p{{Ll}}+$')"),
    "k3_dictionary_matches": (lambda s, d: tk.dictionary_spans(docs(s, d), first_terms(s, d), 2), f"WITH {SQL_TOKENS}, b AS (SELECT DISTINCT lower(x[1] || ' ' || x[2]) AS term FROM (SELECT regexp_extract_all(text, '{TOK}') AS x FROM benchmark) WHERE len(x) > 1), w AS (SELECT doc_id, pos AS start, pos + 2 AS \"end\", tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS value FROM tok) SELECT * FROM w WHERE lower(value) IN (FROM b)"),
    "k2_windows_up_to": (lambda s, d: tk.windows_up_to(docs(s, d), r"^\p{Lu}\p{Ll}+( \p{Ll}+){0,2}$", 3), f"WITH {SQL_TOKENS}, n AS (SELECT doc_id, pos, tok, lead(tok) OVER o AS b, lead(tok, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), w AS (SELECT doc_id, pos AS start, pos + 1 AS \"end\", tok AS value FROM n UNION ALL SELECT doc_id, pos, pos + 2, tok || ' ' || b FROM n WHERE b IS NOT NULL UNION ALL SELECT doc_id, pos, pos + 3, tok || ' ' || b || ' ' || c FROM n WHERE c IS NOT NULL) SELECT * FROM w WHERE regexp_matches(value, '^\\p{{Lu}}\\p{{Ll}}+( \\p{{Ll}}+){{0,2}}$')"),
    "k3_mixed_lengths": (lambda s, d: tk.dictionary_matches(docs(s, d), mixed_terms(s, d)), f"WITH {SQL_TOKENS}, b AS (SELECT DISTINCT lower(array_to_string(x[1:1 + item_id % 3], ' ')) AS term FROM (SELECT item_id, regexp_extract_all(text, '{TOK}') AS x FROM benchmark) WHERE len(x) >= 3), n AS (SELECT doc_id, pos, tok, lead(tok) OVER o AS b, lead(tok, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)), w AS (SELECT doc_id, pos AS start, pos + 1 AS \"end\", tok AS value FROM n UNION ALL SELECT doc_id, pos, pos + 2, tok || ' ' || b FROM n WHERE b IS NOT NULL UNION ALL SELECT doc_id, pos, pos + 3, tok || ' ' || b || ' ' || c FROM n WHERE c IS NOT NULL) SELECT * FROM w WHERE lower(value) IN (FROM b)"),
    "k10_fold_marks": (lambda s, d: docs(s, d).select("doc_id", tk.fold_marks(F.concat(F.col("text"), F.lit(" ǖ ș Ḁ e\u0301"))).alias("folded")), "SELECT doc_id, strip_accents(text || ' ǖ ș Ḁ e\u0301') AS folded FROM documents"),
    "k4_span_pattern": (lambda s, d: tk.adjacent(spans(s, d, CAP), spans(s, d, LOW), gap=1).join(spans(s, d, "^,$").select("doc_id", F.col("start").alias("end")), ["doc_id", "end"], "left_semi").select("doc_id", "start", F.col("end_r").alias("end"), F.concat_ws(", ", "value", "value_r").alias("value")), f"WITH {SQL_TOKENS}, w AS (SELECT doc_id, pos, tok, lead(tok) OVER o AS b, lead(tok, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos AS start, pos + 3 AS \"end\", tok || ', ' || c AS value FROM w WHERE regexp_matches(tok, '^\\p{{Lu}}\\p{{Ll}}+$') AND b = ',' AND regexp_matches(c, '^\\p{{Ll}}+$')"),
    "k5_drop_contained": (lambda s, d: tk.drop_contained(tk.window_spans(docs(s, d), r"^\p{Lu}+ ?$", 1).unionByName(tk.window_spans(docs(s, d), r"^\p{Lu}+ [^ ]+$", 2))).select("doc_id", "start", "end"), f"WITH {SQL_TOKENS}, w AS (SELECT doc_id, pos AS start, pos + 1 AS e FROM tok WHERE regexp_matches(tok, '^\\p{{Lu}}+$') UNION ALL SELECT doc_id, pos, pos + 2 FROM (SELECT *, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM tok) WHERE regexp_matches(tok, '^\\p{{Lu}}+$') AND n IS NOT NULL) SELECT doc_id, start, e AS \"end\" FROM w WHERE NOT EXISTS (SELECT 1 FROM w v WHERE v.doc_id = w.doc_id AND v.start <= w.start AND v.e >= w.e AND (v.start, v.e) <> (w.start, w.e))"),
    "k6_overlaps": (lambda s, d: _overlaps(s, d), "WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS a, o_orderdate::DATE + 30 AS b FROM orders) SELECT x.o_orderkey AS k, y.o_orderkey AS l FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a < y.b AND y.a < x.b"),
    "k7_concat_tokens": (lambda s, d: docs(s, d).select("doc_id", F.array_join(F.slice(tk.token_array(F.col("text")), 1, 6), " ").alias("value")), f"WITH {SQL_TOKENS} SELECT doc_id, array_to_string(a[1:6], ' ') AS value FROM t"),
    "k8_lookup": (lambda s, d: tk.tokens(docs(s, d)).withColumn("term", F.lower("tok")).join(tk.tokens(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.lower("tok").alias("term")).distinct(), "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n")), f"WITH {SQL_TOKENS}, b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{TOK}'))) AS term FROM benchmark) SELECT doc_id, count(*) AS n FROM tok WHERE lower(tok) IN (FROM b) GROUP BY 1"),
    "k9_paths": (lambda s, d: table(s, d, "supplier").select("s_suppkey", F.expr("xpath_string(concat('<m><n part=\"', s_nationkey, '\">', s_name, '</n><n>x</n></m>'), 'm/n[1]')").alias("name"), F.expr("xpath_int(concat('<m><n part=\"', s_nationkey, '\">', s_name, '</n></m>'), 'm/n/@part')").alias("part"), F.expr("size(xpath(concat('<m><n>', s_name, '</n><n>x</n></m>'), 'm/n/text()'))").alias("n")), "SELECT s_suppkey, s_name AS name, s_nationkey AS part, 2 AS n FROM supplier"),
    "k10_fold_accents": (lambda s, d: docs(s, d).select("doc_id", tk.fold_accents(F.col("text")).alias("folded")), f"SELECT doc_id, translate(text, '{tk.ACCENTED}', '{tk.PLAIN}') AS folded FROM documents"),
    "k11_roman": (lambda s, d: table(s, d, "orders").select("o_orderkey", tk.roman(F.expr("o_orderkey % 3999 + 1")).alias("roman")).withColumn("value", tk.roman_value(F.lower("roman"))).withColumn("ok", tk.is_roman(F.concat(F.lit("IX"), "roman"))), "WITH x AS (SELECT o_orderkey, (o_orderkey % 3999 + 1)::INT AS n FROM orders), r AS (SELECT *, repeat('M', n // 1000) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS roman FROM x) SELECT o_orderkey, roman, n AS value, regexp_matches('IX' || roman, '^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$') AS ok FROM r"),
    "j1_term_frequency": (lambda s, d: ts.frequencies(tk.tokens(docs(s, d))), f"WITH {SQL_TOKENS}, n AS (SELECT count(*) AS total FROM tok) SELECT lower(tok) AS term, count(*) AS n, total, count(*) / total AS freq_norm, count(*) / total AS freq_smooth FROM tok, n GROUP BY 1, total"),
    "j2_j4_positions": (lambda s, d: ts.position_family(positions(s, d)), f"WITH {SQL_POS}, c AS (SELECT term, count(*) AS n, sum((pos = 0)::INT)::BIGINT AS n_start, sum((next IS NULL)::INT)::BIGINT AS n_end, sum((depth > 0)::INT)::BIGINT AS n_bracket, sum(coalesce(after_comma, false)::INT)::BIGINT AS n_comma FROM p GROUP BY 1) SELECT term, n, {_family} FROM c"),
    "j3_successors": (lambda s, d: ts.successors(ts.with_positions(tk.tokens(docs(s, d)))), f"WITH {SQL_TOKENS}, p AS (SELECT lower(tok) AS term, lead(lower(tok)) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok), c AS (SELECT term, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY term) AS distinct_next, n / count(*) OVER (PARTITION BY term) AS succ_norm FROM c"),
    "j3_term_profile": (profile, f"WITH {SQL_TOKENS}, p AS (SELECT doc_id, pos, lower(tok) AS term, lead(lower(tok)) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok), g AS (SELECT lang, term, next, count(*) AS c, sum((pos = 0)::INT) AS s FROM p JOIN documents USING (doc_id) GROUP BY 1, 2, 3), b AS (SELECT lang, term, sum(c)::BIGINT AS n, sum(s) AS st, arg_min(next, (-c, next)) FILTER (WHERE next IS NOT NULL) AS successor FROM g GROUP BY 1, 2) SELECT lang, term, n, round(n / sum(n) OVER (PARTITION BY lang), 9) AS share, round(st / n, 9) AS start_share, successor FROM b"),
    "j5_stop_words": (stops, f"WITH {SQL_TOKENS}, c AS (SELECT lower(tok) AS term, count(*) AS n, sum((tok = lower(tok))::INT)::BIGINT AS stop FROM tok GROUP BY 1) SELECT *, n < 2 * stop AS is_stop, n = stop AS only_stop, stop / sum(stop) OVER () AS stop_norm FROM c"),
    "j6_abbreviation_closure": (lambda s, d: ts.closure(abbreviations(s, d)), f"WITH RECURSIVE {SQL_CLOSURE} SELECT short, form, min(dist)::INT AS dist FROM c GROUP BY 1, 2"),
    "j6_best_full_form": (lambda s, d: ts.best_full_form(abbreviations(s, d)), f"WITH {SQL_ABBR} SELECT short, arg_min(form, (-n, form)) AS form FROM e GROUP BY 1"),
    "j7_inherited_flags": (inherited, f"WITH RECURSIVE {SQL_CLOSURE}, {FLAGS} SELECT short, bool_or(flag) AS flag FROM c JOIN f USING (form) GROUP BY 1"),
    "j8_dictionaries": (lambda s, d: ts.position_family(positions(s, d)).select("term", (F.col("n_bracket") > 0).alias("in_bracket"), (F.col("n_comma") > 0).alias("after_comma"), F.col("term").rlike(r"^\p{L}").alias("word")), f"WITH {SQL_POS} SELECT term, bool_or(depth > 0) AS in_bracket, bool_or(coalesce(after_comma, false)) AS after_comma, regexp_matches(term, '^\\p{{L}}') AS word FROM p GROUP BY term"),
    "j9_merge_counts": (lambda s, d: ts.merge_counts(*(tk.tokens(table(s, d, t).select(F.col(k).alias("doc_id"), "text")).groupBy(F.lower("tok").alias("term")).agg(F.count("*").alias("n")) for t, k in (("documents", "doc_id"), ("benchmark", "item_id"), ("conversations", "conv_id")))), f"WITH x AS (SELECT text FROM documents UNION ALL SELECT text FROM benchmark UNION ALL SELECT text FROM conversations) SELECT term, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '{TOK}'))) AS term FROM x) GROUP BY 1"),
    "s13_term_lines": (lines, f"WITH {SQL_POS}, c AS (SELECT term, count(*) AS n FROM p GROUP BY 1), q AS (SELECT term, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY 1, 2), l AS (SELECT term, string_agg(next || ':' || n, ' ' ORDER BY n DESC, next) AS s FROM q GROUP BY 1) SELECT term, term || chr(9) || n || chr(9) || coalesce(s, '') AS line FROM c LEFT JOIN l USING (term)"),
    "s13_term_lines_read": (lambda s, d: ts.from_lines(lines(s, d)).select("term", "n", F.size(F.coalesce("successors", F.create_map())).alias("k")), f"WITH {SQL_POS}, q AS (SELECT term, count(DISTINCT next) AS k, count(*) AS n FROM p GROUP BY 1) SELECT term, n, k::INT AS k FROM q"),
}


def _overlaps(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 30).alias("b"))
    x, y = o.alias("x"), o.alias("y")
    same = (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey"))
    return x.join(y, same & tk.overlaps(F.col("x.a"), F.col("x.b"), F.col("y.a"), F.col("y.b"))).select(F.col("x.o_orderkey").alias("k"), F.col("y.o_orderkey").alias("l"))
