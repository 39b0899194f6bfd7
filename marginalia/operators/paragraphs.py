"""Lines and paragraphs of a page's blocks, and readings of page numbers.

A block's lines have line (their order) and box, see layout; rules are windows over a block,
which is one group: a page has a few hundred lines at most. Lengths are whole pixels, and means
are cut to whole pixels, as the rules compare them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import box, height


def _whole(total: Column, n: Column) -> Column:
    """A mean cut towards zero; 0 of nothing."""
    return F.when(n == 0, 0).otherwise((total / n).cast("int"))


def merge_fragments(lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, line, box, and baseline and font_size if lines have them): fragments that stand side by side, in whatever order they come, as one line.

    Fragments whose middle halves overlap vertically, one by one, are a row; that is found by
    one sweep downwards, so it is the components of that relation and not the one before only.
    In a row, what overlaps horizontally with something on its left is a line of its own.
    Baselines and font sizes are means of those over 0. Lines less than half as high as the
    block's mean are dropped, but for the first. Lines are numbered from 1 downwards, then from left to right.
    """
    block = Window.partitionBy(*key)
    quarter = height(F.col("box")) / 4
    swept = block.orderBy("__top", "box.l", "line")
    before = swept.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("__top", F.col("box.t") + quarter).withColumn("__end", F.col("box.b") - quarter)
    rows = rows.withColumn("__new", F.coalesce((F.col("__top") >= F.max("__end").over(before)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__row", F.sum("__new").over(swept.rowsBetween(Window.unboundedPreceding, 0)))
    left = Window.partitionBy(*key, "__row").orderBy("box.l", "box.r", "line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.when(F.col("box.l") < F.max("box.r").over(left), F.col("line")))
    means = [_whole(F.sum(F.when(F.col(c) > 0, F.col(c))), F.count(F.when(F.col(c) > 0, F.col(c)))).alias(c) for c in ("baseline", "font_size") if c in lines.columns]
    joined = rows.groupBy(*key, "__row", "__own").agg(box(F.min("box.l"), F.max("box.r"), F.min("box.t"), F.max("box.b")).alias("box"), *means)
    numbered = joined.withColumn("line", F.row_number().over(block.orderBy("__row", "box.l", F.col("__own").asc_nulls_first())))
    mean = _whole(F.sum(height(F.col("box"))).over(block), F.count("*").over(block))
    tall = (F.col("line") == 1) | (height(F.col("box")) * 2 >= mean)
    return numbered.withColumn("__tall", tall).filter("__tall").select(*key, "line", "box", *([c for c in ("baseline", "font_size") if c in lines.columns]))


def _renumbered(lines: DataFrame, key: list[str], split: Column) -> DataFrame:
    """lines with para anew: a new one at each line that split marks, and wherever there was one."""
    over = Window.partitionBy(*key).orderBy("line")
    first = F.coalesce(F.lag("para").over(over) != F.col("para"), F.lit(False))
    marked = lines.withColumn("__new", (first | F.coalesce(split, F.lit(False))).cast("int"))
    return marked.withColumn("para", F.sum("__new").over(over.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def split_starts(lines: DataFrame, key: list[str], dpi: int) -> DataFrame:
    """lines (with preliminary para) split where their starts are those of paragraphs.

    Starts are from the block's left edge. What is lower than half the mean height, or begins
    beyond a third of the block's width, doesn't count for the bounds and means. Blocks whose
    starts vary by less than dpi / 20 stay. With three preliminary paragraphs or more, a line
    nearer to the mean start of their first lines than to that of all lines begins one.
    With fewer, lines nearer to the largest start do where these are few (indent), and the
    others do where those are few (exdent): half as many at most in paragraphs of four to nine
    lines, two thirds from ten lines on; shorter ones stay.
    """
    block = Window.partitionBy(*key)
    part = Window.partitionBy(*key, "para")
    mean = _whole(F.sum(height(F.col("box"))).over(block), F.count("*").over(block))
    start = F.col("box.l") - F.min("box.l").over(block)
    width = F.max("box.r").over(block) - F.min("box.l").over(block)
    rows = lines.withColumn("__s", start).withColumn("__tall", height(F.col("box")) * 2 >= F.floor(mean / 2) * 2).withColumn("__counts", F.col("__tall") & (start * 3 <= width))
    rows = rows.withColumn("__first", F.row_number().over(part.orderBy("line")) == 1).withColumn("__n", F.count("*").over(part))
    of = lambda c: F.when(F.col("__counts") & c, F.col("__s"))
    some, firsts = of(F.lit(True)), of(F.col("__first"))
    rows = rows.withColumn("__min", F.min(some).over(block)).withColumn("__max", F.max(some).over(block))
    rows = rows.withColumn("__mean", _whole(F.sum(some).over(block), F.count(some).over(block))).withColumn("__mean_first", _whole(F.sum(firsts).over(block), F.count(firsts).over(block)))
    right = F.abs(F.col("__s") - F.col("__max")) < F.abs(F.col("__s") - F.col("__min"))
    rows = rows.withColumn("__right", right)
    rights = F.sum((F.col("__tall") & F.col("__right")).cast("int")).over(block)
    lefts = F.sum((F.col("__tall") & ~F.col("__right")).cast("int")).over(block)
    rows = rows.withColumn("__rights", rights).withColumn("__lefts", lefts).withColumn("__paras", F.sum(F.col("__first").cast("int")).over(block))
    few = lambda a, b: F.when(F.col("__n") < 4, False).when(F.col("__n") < 10, a * 2 <= b).otherwise(a * 3 <= b * 2)
    by_share = F.when(F.col("__right"), few(F.col("__rights"), F.col("__lefts"))).otherwise(few(F.col("__lefts"), F.col("__rights")))
    by_mean = F.abs(F.col("__s") - F.col("__mean")) > F.abs(F.col("__s") - F.col("__mean_first"))
    split = ~F.col("__first") & (F.col("__max") - F.col("__min") >= dpi // 20) & F.when(F.col("__paras") < 3, by_share).otherwise(by_mean)
    return _renumbered(rows, key, split).select(*lines.columns)


def split_margins(lines: DataFrame, key: list[str], dpi: int) -> DataFrame:
    """lines (with preliminary para) split where the space above is a paragraph's: nearer to the mean space between preliminary paragraphs than to that between lines, and over dpi / 20 and three halves of the latter. Blocks of fewer than three paragraphs stay."""
    block = Window.partitionBy(*key)
    part = Window.partitionBy(*key, "para")
    rows = lines.withColumn("__first", F.row_number().over(part.orderBy("line")) == 1).withColumn("__bottom", F.max("box.b").over(part)).withColumn("__top", F.min("box.t").over(part))
    order = block.orderBy("line")
    rows = rows.withColumn("__gap", F.col("box.t") - F.lag("box.b").over(order)).withColumn("__between", F.when(F.col("__first"), F.col("__top") - F.lag("__bottom").over(order)))
    mean = lambda c: _whole(F.sum(c).over(block), F.count(c).over(block))
    rows = rows.withColumn("__lines", mean("__gap")).withColumn("__paragraphs", mean("__between")).withColumn("__paras", F.sum(F.col("__first").cast("int")).over(block))
    least = F.greatest(F.lit(dpi // 20), (F.col("__lines") * 3 / 2).cast("int"))
    nearer = F.abs(F.col("__gap") - F.col("__lines")) > F.abs(F.col("__gap") - F.col("__paragraphs"))
    split = ~F.col("__first") & (F.col("__paras") >= 3) & nearer & (least < F.col("__gap"))
    return _renumbered(rows, key, split).select(*lines.columns)


#: Characters and the figures that they may be read as.
READINGS = {**{str(k): str(k) for k in range(10)}, "l": "17", "I": "1", "i": "1", "|": "1", "!": "1", "O": "06", "o": "0", "Q": "0", "D": "0", "S": "58", "s": "5", "B": "83", "Z": "27", "z": "2", "g": "96", "q": "9", "G": "6", "b": "6", "T": "7", "A": "4"}
#: Tokens at the top and at the bottom of a page that may be its number; figures are fewer than this.
EDGE, FIGURES = 25, 6


def page_readings(tokens: DataFrame) -> DataFrame:
    """tokens (doc, page, pos, size, str, ocred) that may be page numbers, once for each value: value, fuzzy (characters of several readings), ambiguity (readings in all).

    pos is the token's place on its page, size the page's number of tokens; only the first and
    last EDGE count. On pages that weren't scanned figures are read as they are; on others
    each character may be several figures, and all combinations are readings. None has
    FIGURES figures or more, and none begins with 0.
    """
    near = (F.col("pos") <= EDGE) | (F.col("pos") + 1 >= F.col("size") - EDGE)
    table = F.create_map(*(F.lit(x) for c, d in READINGS.items() for x in (c, d)))
    own = F.filter(F.split("str", ""), lambda c: c != "")
    digits = F.when(F.col("ocred"), F.transform(own, lambda c: F.split(F.try_element_at(table, c), ""))).otherwise(F.when(F.col("str").rlike("^[0-9]+$"), F.transform(own, lambda c: F.array(c))))
    rows = tokens.filter(near & F.length("str").between(1, FIGURES - 1)).withColumn("__d", digits)
    rows = rows.filter(F.col("__d").isNotNull() & ~F.exists("__d", lambda d: d.isNull())).filter(F.col("__d")[0] != F.array(F.lit("0")))
    ambiguity = F.aggregate("__d", F.lit(1), lambda n, d: n * F.size(d))
    fuzzy = F.size(F.filter("__d", lambda d: F.size(d) > 1))
    every = F.aggregate("__d", F.array(F.lit("")), lambda said, d: F.flatten(F.transform(said, lambda s: F.transform(d, lambda x: F.concat(s, x)))))
    read = rows.select("doc", "page", "pos", "str", fuzzy.alias("fuzzy"), ambiguity.alias("ambiguity"), F.explode(every).alias("__v"))
    return read.filter(~F.col("__v").startswith("0")).withColumn("value", F.col("__v").cast("int")).drop("__v")


def best_readings(scored: DataFrame) -> DataFrame:
    """Of readings with score the best of each page: by the score over fuzziness and ambiguity together (whole), then the less ambiguous, then the smaller value, then the place."""
    adjusted = F.floor(F.col("score") / (F.col("fuzzy") + F.col("ambiguity")))
    best = Window.partitionBy("doc", "page").orderBy(F.desc(adjusted), F.col("fuzzy") + F.col("ambiguity"), "value", "pos")
    return scored.withColumn("__r", F.row_number().over(best)).filter("__r = 1").drop("__r")
