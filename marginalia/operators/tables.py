"""Tables as long frames of cells (table_id, r, c, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Figures, signs and Roman numerals only.
NUMERIC = r"^([0-9.,:;+\-±%()\s]*[0-9][0-9.,:;+\-±%()\s]*|[IVXLCDM]+)$"


def grid(cells: DataFrame) -> DataFrame:
    """(table_id, r, c, text, spanned) of raw cells (table_id, sec, r, ord, colspan, rowspan, text).

    Head rows come first and foot rows last; a cell takes the next free place of its row and
    fills its spans; a cell over the full width ignores its rowspan; places without a cell
    are missing ("" and spanned null). Filling is sequential, so a table is in one task, but
    its rows are streamed in order: besides the row at hand only spans from above are held.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("table_id", "__sec", "r", "__width", "colspan", "rowspan", "text")
        table, k, out = None, 0, []
        above: list[list[tuple[int, str]]] = []  # for each column (end, text) of spans, the last one first to end

        def fill(row: list, width: int) -> None:
            nonlocal above
            above = above or [[] for _ in range(width)]
            places = []
            for spans in above:
                while spans and spans[-1][0] <= k:
                    spans.pop()
                places.append((spans[-1][1], True) if spans else None)
            c = 0
            for wide, high, text in row:
                while c < width and places[c]:
                    c += 1
                for j in range(c, min(c + wide, width)):
                    places[j] = (text, j > c)
                    if wide < width and high > 1:
                        while above[j] and above[j][-1][0] <= k + high:
                            above[j].pop()
                        above[j].append((k + high, text))
                c += wide
            out.extend((table, k, c, *(x or ("", None))) for c, x in enumerate(places))

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["table_id", "r", "c", "text", "spanned"])
            out.clear()
            return batch

        types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
        at, row, width = None, [], 0
        for batch in batches:
            for t, *place, w, wide, high, text in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if at != (t, *place):
                    if row:
                        fill(row, width)
                        k += 1
                    if at is None or at[0] != t:
                        k, above = 0, []
                    at, row, width, table = (t, *place), [], w, t
                    if len(out) >= 10_000:
                        yield told()
                row.append((wide, high, text))
        if row:
            fill(row, width)
        if out:
            yield told()

    order = F.when(F.col("sec") == "head", 0).when(F.col("sec") == "body", 1).when(F.col("sec") == "foot", 2).otherwise(F.raise_error(F.concat(F.lit("no section: "), "sec")))
    known = cells.filter("sec IS NOT NULL AND r IS NOT NULL")
    widths = known.groupBy("table_id", "sec", "r").agg(F.sum("colspan").alias("w")).groupBy(F.col("table_id").alias("__t")).agg(F.max("w").cast("int").alias("__width"))
    rows = known.join(widths, F.col("table_id").eqNullSafe(F.col("__t"))).select("table_id", order.cast("int").alias("__sec"), "r", "ord", "__width", "colspan", "rowspan", "text")
    ordered = rows.repartition("table_id").sortWithinPartitions("table_id", "__sec", "r", "ord")
    return ordered.mapInArrow(build, "table_id long, r int, c int, text string, spanned boolean")


def is_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC)


def classify(cells: DataFrame) -> DataFrame:
    """(table_id, type): data if of the cells with text outside the first row and column over three quarters are numeric; else attribute."""
    inner = (F.col("r") > 0) & (F.col("c") > 0) & (F.length(F.coalesce("text", F.lit(""))) > 0)
    counts = cells.groupBy("table_id").agg(F.sum(F.when(inner & is_numeric(F.col("text")), 1).otherwise(0)).alias("k"), F.sum(F.when(inner, 1).otherwise(0)).alias("n"))
    return counts.select("table_id", F.when(F.col("k") * 4 > F.col("n") * 3, "data").otherwise("attribute").alias("type"))


def row_types(cells: DataFrame) -> DataFrame:
    """(table_id, r, type): header if no cell but the first is numeric, empty without text, else data."""
    text = F.length(F.coalesce("text", F.lit(""))) > 0
    counts = cells.groupBy("table_id", "r").agg(F.sum(F.when(text & (F.col("c") > 0) & is_numeric(F.col("text")), 1).otherwise(0)).alias("k"), F.sum(F.when(text, 1).otherwise(0)).alias("n"))
    return counts.select("table_id", "r", F.when(F.col("n") == 0, "empty").when(F.col("k") == 0, "header").otherwise("data").alias("type"))


def headers(cells: DataFrame) -> DataFrame:
    """(table_id, c, header, name): each column's text in the table's first header row, and as an attribute name."""
    first = row_types(cells).filter("type = 'header'").groupBy("table_id").agg(F.min("r").alias("r"))
    return cells.join(first, ["table_id", "r"]).select("table_id", "c", F.col("text").alias("header"), F.regexp_replace("text", r"[^0-9A-Za-z\-._]+", "_").alias("name"))


def orientation(cells: DataFrame, known: DataFrame) -> DataFrame:
    """(table_id, headers_in): row or column, by the mean frequency of the first row's and first column's texts among known header texts (header, n)."""
    scored = cells.filter("r = 0 OR c = 0").join(known, cells.text == known.header, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = scored.groupBy("table_id").agg(*(F.sum(F.when(F.col(k) == 0, F.col("n")).otherwise(0)).alias(f"s{k}") for k in "rc"), *(F.sum(F.when(F.col(k) == 0, 1).otherwise(0)).alias(f"n{k}") for k in "rc"))
    return sums.select("table_id", F.when(F.col("sr") * F.col("nc") >= F.col("sc") * F.col("nr"), "row").otherwise("column").alias("headers_in"))


def extract(cells: DataFrame) -> DataFrame:
    """(table_id, r, name, text, line): every data cell with its column's name and its row's first text."""
    return _extracted(cells).drop("c")


def _extracted(cells: DataFrame) -> DataFrame:
    """The same with c."""
    data = row_types(cells).filter("type = 'data'").select("table_id", "r")
    label = F.first("text").over(Window.partitionBy("table_id", "r").orderBy("c"))
    return cells.join(data, ["table_id", "r"], "left_semi").withColumn("line", label).filter("c > 0").join(headers(cells).drop("header"), ["table_id", "c"]).select("table_id", "r", "c", "name", "text", "line")


def abbreviations(cells: DataFrame) -> DataFrame:
    """(table_id, r, key, values): the first word of each row's first cell keyed to the row's other cells by column name.

    A key that rows of a table share is repeated, once a row; of columns with the same name
    the first with text counts, or the first.
    """
    word = F.regexp_extract("line", r"[\p{L}0-9]+", 0)
    cell = F.struct((F.length(F.coalesce("text", F.lit(""))) == 0).alias("empty"), "c", "text")
    one = _extracted(cells).groupBy("table_id", "r", word.alias("key"), "name").agg(F.min(cell)["text"].alias("text"))
    return one.groupBy("table_id", "r", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "text")))).alias("values"))


def append_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Tables of both frames with the same id as one, bottom's rows after top's; only tables with as many columns in both."""
    size = lambda t, k: t.groupBy("table_id").agg(F.count_distinct("r").alias(f"{k}_r"), F.count_distinct("c").alias(f"{k}_c"))
    fit = size(top, "a").join(size(bottom, "b"), "table_id").filter("a_c = b_c").select("table_id", "a_r")
    return top.join(fit.select("table_id"), "table_id", "left_semi").unionByName(bottom.join(fit, "table_id").withColumn("r", (F.col("r") + F.col("a_r")).cast("int")).drop("a_r"))


def append_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same side by side; only tables with as many rows in both."""
    turn = lambda t: t.select("table_id", F.col("c").alias("r"), F.col("r").alias("c"), "text")
    return turn(append_rows(turn(left), turn(right)))


def preview(cells: DataFrame, chars: int = 12, rows: int = 3) -> DataFrame:
    """(table_id, label): the first rows' texts, shortened, as HTML rows."""
    cell = F.concat(F.lit("<td>"), F.substring(F.coalesce("text", F.lit("")), 1, chars), F.lit("</td>"))
    lines = cells.filter(F.col("r") < rows).groupBy("table_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", cell.alias("t")))), lambda x: x["t"]), "").alias("t"))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: F.concat(F.lit("<tr>"), x["t"], F.lit("</tr>"))), "").alias("label"))
