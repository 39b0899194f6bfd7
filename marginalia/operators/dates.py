"""Dates in text: parts, ranges, enumerations, and their assembly by joins of adjacent spans.

Spans have (doc_id, start, end, value) and maybe value_max. Everything joins on the
document and a token position, so one shuffle by document serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import is_roman, roman_value

#: Month names in English, German, French and Spanish, with common short forms.
MONTHS = {
    1: "january jan januar janvier enero", 2: "february feb februar février febrero", 3: "march mar märz mars marzo", 4: "april apr avril abril",
    5: "may mai mayo", 6: "june jun juni juin junio", 7: "july jul juli juillet julio", 8: "august aug août agosto",
    9: "september sep sept septembre septiembre", 10: "october oct oktober octobre octubre", 11: "november nov novembre noviembre", 12: "december dec dezember décembre diciembre",
}
#: What makes a number of a day an ordinal one.
ORDINALS = ("st", "nd", "rd", "th")
BRIDGES = (".", ",", "-", "/")
RANGES = ("-", "–", "to", "bis")
SEPARATORS = (",", "and", "und", "&")


def month_value(tok: Column) -> Column:
    """Two digits of a month by name, Roman or Arabic number; else null."""
    names = F.create_map(*(x for m, ns in MONTHS.items() for n in ns.split() for x in (F.lit(n), F.lit(m))))
    n = F.when(tok.rlike("^[0-9]{1,2}$"), tok.cast("int")).when(is_roman(tok), roman_value(tok)).otherwise(F.try_element_at(names, F.lower(tok)))
    return F.when(n.between(1, 12), F.lpad(n.cast("string"), 2, "0"))


def day_value(tok: Column) -> Column:
    n = F.when(tok.rlike("^[0-9]{1,2}$"), tok.cast("int"))
    return F.when(n.between(1, 31), F.lpad(n.cast("string"), 2, "0"))


def year_value(tok: Column, doc_year: int, two_digits: Column | None = None) -> Column:
    """A year of four digits, or of two where they are allowed: a century is added while that stays before the document's year."""
    short = F.when(tok.rlike("^[0-9]{2}$"), tok.cast("int"))
    full = short + 100 * F.greatest(F.lit(0), F.ceil((F.lit(doc_year) - short) / 100.0) - 1)
    four = F.when(tok.rlike("^[12][0-9]{3}$"), tok)
    return four if two_digits is None else F.coalesce(four, F.when(two_digits, full.cast("int").cast("string")))


def parts(tokens: DataFrame, kind: str, doc_year: int = 2025) -> DataFrame:
    """Spans of days (d), months (m) or years (y); a year of two digits needs an apostrophe before it."""
    prev = F.lag("tok").over(Window.partitionBy("doc_id").orderBy("pos"))
    value = {"d": day_value(F.col("tok")), "m": month_value(F.col("tok")), "y": year_value(F.col("tok"), doc_year, F.col("__prev") == "'")}[kind]
    near = tokens.withColumn("__prev", prev) if kind == "y" else tokens.withColumn("__next", F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos"))) if kind == "d" else tokens
    found = near.withColumn("value", value).filter("value IS NOT NULL")
    size = 1 + (F.coalesce(F.lower("__next").isin(*ORDINALS), F.lit(False)).cast("int") if kind == "d" else F.lit(0))
    return found.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + size).alias("end"), "value", F.col("tok").alias("said"))


def words(tokens: DataFrame, chosen: tuple[str, ...]) -> DataFrame:
    return tokens.filter(F.lower("tok").isin(*chosen)).select("doc_id", F.col("pos").alias("at"), F.col("tok").alias("word"))


def ranges(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """Two spans with a range word between and rising values as one: value and value_max."""
    left = spans.select("doc_id", "start", F.col("end").alias("at"), "value")
    right = spans.select("doc_id", (F.col("start") - 1).alias("at"), "end", F.col("value").alias("value_max"))
    return left.join(words(tokens, RANGES), ["doc_id", "at"]).join(right, ["doc_id", "at"]).filter("value < value_max").select("doc_id", "start", "end", "value", "value_max")


def enumerations(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, values): runs of two or more spans, separators between them, of one style (figures, Roman or names) and with values that rise; a break in any starts a new run."""
    held = words(tokens, SEPARATORS).withColumn("sep", F.lit(True))
    w = Window.partitionBy("doc_id").orderBy("start")
    marked = spans.join(held, (spans.doc_id == held.doc_id) & (spans.start - 1 == held.at), "left").select(spans["*"], "sep")
    style = F.when(F.col("said").rlike("[0-9]$"), 1).when(is_roman(F.element_at(F.split("said", " "), -1)), 2).otherwise(3) if "said" in spans.columns else F.lit(0)
    marked = marked.withColumn("__style", style)
    goes = (F.lag("end").over(w) == F.col("start") - 1) & F.col("sep") & (F.lag("value").over(w) < F.col("value")) & (F.lag("__style").over(w) == F.col("__style"))
    run = marked.withColumn("__new", F.when(F.coalesce(goes, F.lit(False)), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = run.groupBy("doc_id", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list("value")).alias("values"))
    return out.filter(F.size("values") > 1).drop("__run")


def pairs(first: DataFrame, second: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, start, end, a, b, bridge): second directly after first, or after one bridging token."""
    a = first.select("doc_id", "start", F.col("end").alias("at"), F.col("value").alias("a"), F.col("said").alias("said_a"))
    b = second.select("doc_id", F.col("start").alias("at"), "end", F.col("value").alias("b"), F.col("said").alias("said_b"))
    near = a.join(b, ["doc_id", "at"]).withColumn("bridge", F.lit(""))
    far = a.join(words(tokens, BRIDGES), ["doc_id", "at"]).withColumn("at", F.col("at") + 1).join(b, ["doc_id", "at"]).withColumnRenamed("word", "bridge")
    return near.drop("at").unionByName(far.drop("at"))


def triples(pair: DataFrame, third: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs continued by a third part; both bridges are equal, or one is empty."""
    whole = pairs(pair.withColumn("value", F.struct("a", "b", F.col("bridge").alias("first"))).withColumn("said", F.concat_ws(" ", "said_a", "said_b")), third, tokens)
    fits = (F.col("a.first") == F.col("bridge")) | (F.col("a.first") == "") | (F.col("bridge") == "")
    return whole.filter(fits).select("doc_id", "start", "end", F.col("a.a").alias("p1"), F.col("a.b").alias("p2"), F.col("b").alias("p3"))


#: Orders of a full date's parts; where two fit the same span, the first wins.
ORDERS = ("dmy", "mdy", "ymd", "ydm", "myd", "dym")
#: Tokens after the first one that a full date may have, ordinal endings and apostrophes left out.
REACH = 6


def classified(tokens: DataFrame, doc_year: int = 2025) -> DataFrame:
    """(doc_id, at, x): each token as a struct x of start, end, tok, d, m, y, named, and at, the structs of the next REACH ones.

    An ordinal ending belongs to its number and an apostrophe to the year of two digits after
    it, so they are no tokens of their own. named says of a month that it isn't in figures, R
    for a Roman and N for a name. One shuffle and one sort by document serve both windows.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = tokens.select("doc_id", "pos", "tok", F.lag("tok").over(w).alias("prev"), F.lead("tok").over(w).alias("next"))
    short, tok = F.col("tok").rlike("^[0-9]{1,2}$"), F.col("tok")
    ending = F.coalesce(F.lower("tok").isin(*ORDINALS) & F.col("prev").rlike("^[0-9]{1,2}$"), F.lit(False))
    mark = F.coalesce((tok == "'") & F.col("next").rlike("^[0-9]{2}$"), F.lit(False))
    after = F.coalesce(F.lower("next").isin(*ORDINALS) & short, F.lit(False))
    named = F.when(tok.rlike("^[0-9]"), None).when(is_roman(tok), "R").otherwise("N")
    x = F.struct(
        (F.col("pos") - F.coalesce((F.col("prev") == "'") & short, F.lit(False)).cast("int")).alias("start"), (F.col("pos") + 1 + after.cast("int")).alias("end"), tok.alias("tok"),
        day_value(tok).alias("d"), month_value(tok).alias("m"), year_value(tok, doc_year, F.coalesce(F.col("prev") == "'", F.lit(False))).alias("y"), named.alias("named"),
    )
    kept = near.filter(~ending & ~mark).select("doc_id", "pos", x.alias("x"))
    return kept.select("doc_id", "x", F.array(*(F.lead("x", k).over(w) for k in range(1, REACH + 1))).alias("at")).filter("x.d IS NOT NULL OR x.m IS NOT NULL OR x.y IS NOT NULL")


def _token(k: int) -> Column:
    return F.col("x") if k == 0 else F.col("at")[k - 1]


def _bridged(first: int, second: int) -> tuple[Column, Column | None]:
    """Whether the token between two parts, if there is one, may stand there; and that token."""
    if second == first + 1:
        return F.lit(True), None
    tok = _token(first + 1)["tok"]
    return tok.isin(*BRIDGES), tok


def _candidate(ok: Column, order: str, rank: int, end: Column, least: list[Column], most: list[Column] | None = None) -> Column:
    """A struct of a date whose parts are least, as year, month and day, and of a range up to most; null unless ok."""
    value = F.concat_ws("-", *least)
    return F.when(ok, F.struct(end.alias("end"), F.lit(rank).alias("rank"), F.lit(order).alias("parts"), value.alias("value"), (F.concat_ws("-", *most) if most else F.lit(None).cast("string")).alias("value_max"), F.length(least[0]).alias("__len")))


def _full(orders: tuple[str, ...]) -> list[Column]:
    """Candidates of all orders, with no, one or two bridging tokens, two being equal."""
    out = []
    for rank, o in enumerate(orders):
        for one in (0, 1):
            for two in (0, 1):
                at = (0, 1 + one, 2 + one + two)
                (ok1, b1), (ok2, b2) = _bridged(at[0], at[1]), _bridged(at[1], at[2])
                parts_ = {k: _token(i)[k] for k, i in zip(o, at, strict=True)}
                ok = ok1 & ok2 & (b1 == b2 if one and two else F.lit(True))
                for v in parts_.values():
                    ok = ok & v.isNotNull()
                out.append(_candidate(ok, o, rank, _token(at[2])["end"], [parts_[k] for k in "ymd"]))
    return out


def _ranged(orders: tuple[str, ...]) -> list[Column]:
    """Candidates of ranges of days in one month, and over two months of one style, with a named month and a year after them; ranks come before those of single days."""
    out = []
    between = lambda k: F.lower(_token(k)["tok"]).isin(*RANGES)
    named = lambda k: _token(k)["m"].isNotNull() & _token(k)["named"].isNotNull()
    for o in ("dmy", "mdy"):
        if o not in orders:
            continue
        for one in (0, 1):
            for two in (0, 1):
                d, m = (0, 3 + one) if o == "dmy" else (1 + one, 0)
                y = 4 + one + two
                last = m if o == "dmy" else d + 2
                (ok1, b1), (ok2, b2) = _bridged(d + 2 if o == "dmy" else m, m if o == "dmy" else d), _bridged(last, y)
                low, high, month, year = _token(d)["d"], _token(d + 2)["d"], _token(m)["m"], _token(y)["y"]
                fits = b1 == b2 if one and two and o == "dmy" else F.lit(True)
                out.append(_candidate(ok1 & ok2 & fits & between(d + 1) & (low < high) & named(m) & year.isNotNull(), o, -1, _token(y)["end"], [year, month, low], [year, month, high]))
        for two in (0, 1):
            d1, m1, d2, m2 = (0, 1, 3, 4) if o == "dmy" else (1, 0, 4, 3)
            ok, _ = _bridged(4, 5 + two)
            style = named(m1) & named(m2) & (_token(m1)["named"] == _token(m2)["named"]) & (_token(m1)["m"] < _token(m2)["m"])
            year = _token(5 + two)["y"]
            parts_ = [_token(d1)["d"], _token(d2)["d"], year]
            for v in parts_:
                ok = ok & v.isNotNull()
            out.append(_candidate(ok & between(2) & style, o, -2, _token(5 + two)["end"], [year, _token(m1)["m"], parts_[0]], [year, _token(m2)["m"], parts_[1]]))
    return out


def dates(tokens: DataFrame, orders: tuple[str, ...] = ORDERS, doc_year: int = 2025) -> DataFrame:
    """(doc_id, start, end, value yyyy-MM-dd, value_max, parts, year_len): full dates of all part orders, and ranges of days with their last day in value_max.

    Of equal spans the first order wins, and a range wins over the day that ends it; dates that aren't in the calendar are
    dropped. All orders are read off one window of classified tokens, without a join.
    """
    real = lambda v: F.try_to_timestamp(v, F.lit("yyyy-MM-dd")).isNotNull()
    every = F.filter(F.array(*_ranged(orders), *_full(orders)), lambda c: c.isNotNull())
    some = classified(tokens, doc_year).select("doc_id", F.col("x.start").alias("start"), every.alias("c")).filter(F.size("c") > 0)
    valid = some.withColumn("c", F.filter("c", lambda c: real(c["value"]) & (c["value_max"].isNull() | real(c["value_max"]))))
    best = F.filter("c", lambda c: ~F.exists("c", lambda o: (o["end"] == c["end"]) & (o["rank"] < c["rank"])))
    found = valid.select("doc_id", "start", F.explode(best).alias("c")).select("doc_id", "start", "c.end", "c.value", "c.value_max", "c.parts", F.col("c.__len").alias("year_len"))
    ranged = F.max("value_max").over(Window.partitionBy("doc_id", "end"))
    return found.withColumn("__r", ranged).filter("__r IS NULL OR value_max IS NOT NULL").drop("__r")


def resolve(found: DataFrame) -> DataFrame:
    """Without those dates that overlap one whose text is longer in tokens; equally long ones all stay. Spans (doc_id, start, end)."""
    o = found.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"))
    cond = (found.doc_id == o.doc_id) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")) & (F.col("e") - F.col("s") > F.col("end") - F.col("start"))
    return found.join(o, cond, "left_anti")


def resolve_by_year(found: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, year_len, ...) without repeated ones, and without those that overlap one with a longer year; where years are equally long both stay.

    A document's spans are compared in one row, so they are found once and not for each side of a join.
    """
    near = found.repartition("doc_id").dropDuplicates(["doc_id", "start", "end"]).groupBy("doc_id").agg(F.collect_list(F.struct(*found.columns)).alias("x"))
    covers = lambda o, x: F.coalesce((x["start"] < o["end"]) & (o["start"] < x["end"]) & (o["year_len"] > x["year_len"]) & x["doc_id"].isNotNull(), F.lit(False))
    kept = F.filter("x", lambda x: ~F.exists("x", lambda o: covers(o, x)))
    return near.select(F.inline(kept))


def partial(tokens: DataFrame, order: str, doc_year: int = 2025) -> DataFrame:
    """Two-part dates dm, md, my or ym; a month in figures is not taken, and a bridge only with a Roman month."""
    by = {k: parts(tokens, k, doc_year) for k in order}
    p = pairs(by[order[0]], by[order[1]], tokens)
    said = F.col("said_a") if order[0] == "m" else F.col("said_b")
    value = F.concat_ws("-", *(F.col("a") if order[0] == k else F.col("b") for k in "ymd" if k in order))
    return p.filter(~said.rlike("^[0-9]") & ((F.col("bridge") == "") | is_roman(said))).select("doc_id", "start", "end", value.alias("value"), said.alias("said"))


def shared(enumeration: DataFrame, tail: DataFrame) -> DataFrame:
    """(doc_id, start, end, value): the members of an enumeration that ends where a span with the rest of the date starts, each with that rest."""
    rest = tail.select("doc_id", F.col("start").alias("end"), F.col("end").alias("stop"), F.col("value").alias("rest"))
    return enumeration.join(rest, ["doc_id", "end"]).select("doc_id", "start", F.col("stop").alias("end"), F.explode("values").alias("day"), "rest").select("doc_id", "start", "end", F.concat_ws("-", "rest", "day").alias("value"))


def month_bounds(year: Column, month_min: Column, month_max: Column) -> Column:
    """struct(value_min, value_max) of a range of months: its first and last day."""
    first = F.make_date(year, month_min, F.lit(1))
    return F.struct(first.cast("string").alias("value_min"), F.last_day(F.make_date(year, month_max, F.lit(1))).cast("string").alias("value_max"))


def by_mask(c: Column, mask: str) -> Column:
    """A date from the characters that stand at the mask's y, m and d, filled with zeros; null if lengths differ."""
    pick = lambda k: F.concat(*(F.substring(c, i + 1, 1) for i, x in enumerate(mask) if x == k))
    return F.when(F.length(c) == len(mask), F.concat_ws("-", F.lpad(pick("y"), 4, "0"), F.lpad(pick("m"), 2, "0"), F.lpad(pick("d"), 2, "0")))


def year_list(c: Column) -> Column:
    """Years of an enumeration; a shorter one is completed with the beginning of the first."""
    first = F.regexp_extract(c, "[12][0-9]{3}", 0)
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda y: F.concat(F.substring(first, F.lit(1), F.lit(4) - F.length(y)), y))


def year_range(c: Column) -> Column:
    """struct(value_min, value_max) of a range of years; a shorter last one is completed with the beginning of the first. Null unless they rise."""
    pattern = r"^\s*([12][0-9]{3})\s*[-–]\s*([0-9]{1,4})\s*$"
    first, last = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    whole = F.concat(F.substring(first, F.lit(1), F.lit(4) - F.length(last)), last)
    return F.when((first != "") & (first < whole), F.struct(first.alias("value_min"), whole.alias("value_max")))


def without_numbers(spans: DataFrame, tokens: DataFrame, units: tuple[str, ...]) -> DataFrame:
    """Without single numbers of fewer than four digits, and without spans that a unit follows."""
    after = tokens.filter(F.lower("tok").isin(*units)).select("doc_id", F.col("pos").alias("end"))
    long_ = spans.filter(~((F.col("end") - F.col("start") == 1) & F.col("said").rlike("^[0-9]{1,3}$")))
    return long_.join(after, ["doc_id", "end"], "left_anti")


def shape(c: Column) -> Column:
    """A text's shape: figures as 1, small letters as a, capitals as A, runs as one."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\\p{Lu}+", "A"), "\\p{Ll}+", "a"), "[0-9]+", "1")
    return t


def frequent_shapes(spans: DataFrame) -> DataFrame:
    """Of spans (doc_id, start, end, said) that start at the same token, the one whose shape the document has most, then the longest."""
    counts = spans.withColumn("shape", shape(F.col("said"))).withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "shape")))
    w = Window.partitionBy("doc_id", "start").orderBy(F.desc("n"), F.desc("end"))
    return counts.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
