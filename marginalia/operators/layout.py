"""Page layout: boxes, lines, paragraphs, and page numbers. A box is struct(l, r, t, b), l and t inclusive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(l: Column, r: Column, t: Column, b: Column) -> Column:  # noqa: E741
    return F.struct(l.cast("int").alias("l"), r.cast("int").alias("r"), t.cast("int").alias("t"), b.cast("int").alias("b"))


def width(x: Column) -> Column:
    return x["r"] - x["l"]


def height(x: Column) -> Column:
    return x["b"] - x["t"]


def area(x: Column) -> Column:
    return width(x).cast("long") * height(x)


def includes(x: Column, y: Column, fuzzy: bool = False) -> Column:
    """Whether y is inside x; fuzzy: whether its centre is."""
    if fuzzy:
        cx, cy = F.floor((y["l"] + y["r"]) / 2), F.floor((y["t"] + y["b"]) / 2)
        return (x["l"] <= cx) & (cx < x["r"]) & (x["t"] <= cy) & (cy < x["b"])
    return (x["l"] <= y["l"]) & (y["r"] <= x["r"]) & (x["t"] <= y["t"]) & (y["b"] <= x["b"])


def overlaps(x: Column, y: Column) -> Column:
    return (x["l"] < y["r"]) & (y["l"] < x["r"]) & (x["t"] < y["b"]) & (y["t"] < x["b"])


def union(x: Column, y: Column) -> Column:
    return box(F.least(x["l"], y["l"]), F.greatest(x["r"], y["r"]), F.least(x["t"], y["t"]), F.greatest(x["b"], y["b"]))


def intersect(x: Column, y: Column) -> Column:
    """The common box; null if it is empty."""
    return F.when(overlaps(x, y), box(F.greatest(x["l"], y["l"]), F.least(x["r"], y["r"]), F.greatest(x["t"], y["t"]), F.least(x["b"], y["b"])))


def moved(x: Column, right: Column, down: Column) -> Column:
    return box(x["l"] + right, x["r"] + right, x["t"] + down, x["b"] + down)


def scaled(x: Column, factor: float) -> Column:
    return box(*(F.floor(x[k] * factor) for k in "lrtb"))


def to_text(x: Column) -> Column:
    return F.format_string("[%d,%d,%d,%d]", x["l"], x["r"], x["t"], x["b"])


def from_text(c: Column) -> Column:
    """A box of its text form; null if it isn't one."""
    n = F.split(F.regexp_extract(c, r"^\[([0-9]+,[0-9]+,[0-9]+,[0-9]+)\]$", 1), ",")
    return F.when(F.size(n) == 4, box(*(n[k].try_cast("int") for k in range(4))))


def to_bytes(x: Column) -> Column:
    """Eight bytes, two for each bound."""
    return F.unhex(F.concat(*(F.lpad(F.hex(x[k]), 4, "0") for k in "lrtb")))


def wrap(children: DataFrame, key: list[str], of: str = "box") -> DataFrame:
    """(key, box): the box around each group's boxes."""
    return children.groupBy(*key).agg(box(F.min(f"{of}.l"), F.max(f"{of}.r"), F.min(f"{of}.t"), F.max(f"{of}.b")).alias("box"))


def _island(df: DataFrame, key: list[str], breaks: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy("line")
    return df.withColumn("__b", F.coalesce(breaks.cast("int"), F.lit(0))).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def merge_side_by_side(lines: DataFrame, key: list[str]) -> DataFrame:
    """Lines that overlap vertically by half their height with the one before, on its right, joined to it; lines less than half as high as the mean are dropped."""
    w = Window.partitionBy(*key).orderBy("line")
    mean = F.avg(height(F.col("box"))).over(Window.partitionBy(*key))
    tall = lines.withColumn("__m", mean).filter(height(F.col("box")) * 2 >= F.col("__m")).drop("__m")
    before = F.lag("box").over(w)
    beside = (F.least(before["b"], F.col("box.b")) - F.greatest(before["t"], F.col("box.t"))) * 2 > height(F.col("box"))
    numbered = _island(tall.withColumn("__new", F.coalesce(~(beside & (before["r"] <= F.col("box.l"))), F.lit(True))), key, F.col("__new"), "row").drop("__new")
    return wrap(numbered, [*key, "row"]).withColumnRenamed("row", "line")


def split_short_lines(lines: DataFrame, key: list[str], dpi: int) -> DataFrame:
    """lines with para: a new one after each line that ends more than dpi / 20 before the block's mean right edge; blocks whose right edges vary less aren't split."""
    block = Window.partitionBy(*key)
    w = block.orderBy("line")
    varied = F.max("box.r").over(block) - F.min("box.r").over(block) >= dpi / 20
    marked = lines.withColumn("__short", (F.col("box.r") < F.avg("box.r").over(block) - dpi / 20) & varied).withColumn("__after", F.lag("__short").over(w))
    return _island(marked, key, F.col("__after"), "para").drop("__short", "__after")


def split_indents(lines: DataFrame, key: list[str], dpi: int) -> DataFrame:
    """lines with para: a new one at each indented line, if fewer lines of the block are indented (over dpi / 20 from its left edge) than not; else, at each line that isn't (exdent)."""
    block = Window.partitionBy(*key)
    marked = lines.withColumn("__in", F.col("box.l") - F.min("box.l").over(block) > dpi / 20)
    n, k = F.count("*").over(block), F.sum(F.col("__in").cast("int")).over(block)
    start = F.when(n < 4, False).when(k * 5 <= n * 2, F.col("__in")).when((n - k) * 5 <= n * 2, ~F.col("__in")).otherwise(False)
    return _island(marked.withColumn("__start", start), key, F.col("__start"), "para").drop("__in", "__start")


def split_gaps(lines: DataFrame, key: list[str], factor: float = 1.25, least: int = 5) -> DataFrame:
    """lines with para: a new one where the distance to the line before is factor times the block's mean at least, in blocks of some lines."""
    block = Window.partitionBy(*key)
    gapped = lines.withColumn("__gap", F.col("box.b") - F.lag("box.b").over(block.orderBy("line")))
    wide = (F.col("__gap") >= F.avg("__gap").over(block) * factor) & (F.count("*").over(block) >= least)
    return _island(gapped.withColumn("__wide", wide), key, F.col("__wide"), "para").drop("__gap", "__wide")


def split_paragraphs(lines: DataFrame, key: list[str], dpi: int) -> DataFrame:
    """All three splitters, each within what the one before found; para numbers them within key."""
    one = split_short_lines(lines, key, dpi).withColumnRenamed("para", "__p1")
    two = split_indents(one, [*key, "__p1"], dpi).withColumnRenamed("para", "__p2")
    three = split_gaps(two, [*key, "__p1", "__p2"])
    return three.withColumn("para", F.dense_rank().over(Window.partitionBy(*key).orderBy("__p1", "__p2", "para"))).drop("__p1", "__p2")


def paragraph_layout(lines: DataFrame, key: list[str], dpi: int) -> DataFrame:
    """(key, para, alignment, indentation) of lines with para: centred, justified, left or right, by whether the edges of lines vary; indent, exdent or none, by the first line."""
    w = Window.partitionBy(*key, "para").orderBy("line")
    first = lines.withColumn("__first", F.row_number().over(w) == 1)
    tol = dpi / 20
    a = first.groupBy(*key, "para").agg(F.min_by("box.l", "line").alias("l0"), F.avg(F.when(~F.col("__first"), F.col("box.l"))).alias("l1"), (F.max(F.when(~F.col("__first"), F.col("box.l"))) - F.min(F.when(~F.col("__first"), F.col("box.l")))).alias("dl"), (F.max("box.r") - F.min("box.r")).alias("dr"), (F.max(F.col("box.l") + F.col("box.r")) - F.min(F.col("box.l") + F.col("box.r"))).alias("dc"), F.count("*").alias("n"))
    left, right = F.coalesce(F.col("dl"), F.lit(0)) <= tol, F.col("dr") <= tol
    alignment = F.when(left & right, "justified").when(left, "left").when(right, "right").when(F.col("dc") <= 2 * tol, "center").otherwise("left")
    indentation = F.when(F.col("n") < 2, "none").when(F.col("l0") > F.col("l1") + tol, "indent").when(F.col("l0") < F.col("l1") - tol, "exdent").otherwise("none")
    return a.select(*key, "para", alignment.alias("alignment"), indentation.alias("indentation"))


def vote(values: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value): the only value of a group, or mixed."""
    return values.groupBy(*key).agg(F.when(F.count_distinct(value) == 1, F.min(value)).otherwise("mixed").alias(value))


def fill_from_neighbours(values: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """values whose nulls take the value before, else the one after, else the group's most frequent (the first by name of equals)."""
    w = Window.partitionBy(*key).orderBy(order)
    counts = values.filter(F.col(value).isNotNull()).groupBy(*key, value).count()
    most = counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("__most"))
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return values.withColumn("__x", F.coalesce(before, after)).join(F.broadcast(most) if not key else most, key, "left").withColumn(value, F.coalesce("__x", "__most")).drop("__x", "__most")


#: Characters that are read for a figure.
OCR = {"l": "1", "I": "1", "i": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2", "g": "9"}


def page_candidates(strings: DataFrame) -> DataFrame:
    """strings (doc, page, str) that may be page numbers, with value, and fuzzy: how many characters had to be read as figures. Six figures and more, and a leading 0, are none."""
    digits = F.translate("str", "".join(OCR), "".join(OCR.values()))
    fuzzy = F.length(F.regexp_replace("str", "[0-9]", ""))
    return strings.withColumn("__d", digits).withColumn("fuzzy", fuzzy).filter(F.col("__d").rlike("^[1-9][0-9]{0,4}$") & (F.col("fuzzy") < F.length("str"))).withColumn("value", F.col("__d").cast("int")).drop("__d")


def sequence_scores(candidates: DataFrame) -> DataFrame:
    """candidates with score: pages of a document whose value minus page is the same support each other by their distance, while no more than three pages in a row lack it."""
    line = candidates.withColumn("__diag", F.col("value") - F.col("page"))
    points = line.select("doc", "__diag", "page").distinct()
    w = Window.partitionBy("doc", "__diag").orderBy("page")
    runs = points.withColumn("__new", F.coalesce((F.col("page") - F.lag("page").over(w) > 3).cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("doc", "__diag", "__run")
    before, after = r.orderBy("page").rowsBetween(Window.unboundedPreceding, -1), r.orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    far = lambda over, sign: F.coalesce(sign * (F.sum("page").over(over) - F.count("*").over(over) * F.col("page")), F.lit(0))
    scored = runs.withColumn("score", (far(after, 1) + far(before, -1)).cast("long")).select("doc", "__diag", "page", "score")
    return line.join(scored, ["doc", "__diag", "page"]).drop("__diag")


def best_per_page(scored: DataFrame) -> DataFrame:
    """The candidate of each page with the best score over fuzziness, then the smallest value."""
    w = Window.partitionBy("doc", "page").orderBy(F.desc(F.col("score") / (F.col("fuzzy") + 1)), "fuzzy", "value")
    return scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def repair_numbers(best: DataFrame) -> DataFrame:
    """(doc, page, value): page numbers repaired in order: one that its neighbours outweigh by three to one, or that is missing, continues from the page before, else from the page after. Sequential, so a document is one group."""

    def fix(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("page").reset_index(drop=True)
        value, score = t["value"].tolist(), t["score"].tolist()
        for i in range(1, len(t) - 1):
            step = t["page"][i] - t["page"][i - 1]
            if value[i] != value[i - 1] + step and value[i + 1] == value[i - 1] + t["page"][i + 1] - t["page"][i - 1] and score[i - 1] + score[i + 1] > 3 * score[i]:
                value[i] = value[i - 1] + step
        for i in range(1, len(t)):
            if pd.isna(value[i]) and not pd.isna(value[i - 1]):
                value[i] = value[i - 1] + t["page"][i] - t["page"][i - 1]
        for i in range(len(t) - 2, -1, -1):
            if pd.isna(value[i]) and not pd.isna(value[i + 1]):
                value[i] = value[i + 1] - (t["page"][i + 1] - t["page"][i])
        return pd.DataFrame({"doc": t["doc"], "page": t["page"], "value": value})

    return best.select("doc", "page", "value", "score").groupBy("doc").applyInPandas(fix, "doc long, page long, value long")


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc, pages): selected pages as runs, "a-b" or "a", joined by commas."""
    w = Window.partitionBy("doc").orderBy("page")
    runs = pages.select("doc", "page").distinct().withColumn("__g", F.col("page") - F.row_number().over(w)).groupBy("doc", "__g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    told = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    return runs.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", told.alias("t")))), lambda x: x["t"]), ",").alias("pages"))
