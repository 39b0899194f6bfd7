"""Values of a table's data cells with what they inherit: headers, over spans and several rows, and attributes of their row and of rows above.

A table has cells (table_id, r, c, text), spans already filled in by tables.grid or left
empty, and a type for each row and each column: header, data, attribute or empty. Where
headers are in columns, the table is turned before and its results are turned back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import is_numeric


def line_types(cells: DataFrame, line: str = "r", across: str = "c") -> DataFrame:
    """(table_id, line, type): empty without text; data with a number outside of the first line across; of the others those up to the first data line are header, and the rest attribute."""
    text = F.length(F.trim(F.coalesce("text", F.lit("")))) > 0
    first = cells.groupBy("table_id").agg(F.min(across).alias("__first"))
    told = cells.join(first, "table_id").groupBy("table_id", line).agg(F.sum(text.cast("int")).alias("n"), F.sum((text & (F.col(across) > F.col("__first")) & is_numeric(F.col("text"))).cast("int")).alias("k"))
    begun = F.max((F.col("k") > 0).cast("int")).over(Window.partitionBy("table_id").orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("n") == 0, "empty").when(F.col("k") > 0, "data").when(begun == 0, "header").otherwise("attribute")
    return told.select("table_id", line, kind.alias("type"))


def attribute_name(text: Column) -> Column:
    """A text as an attribute's name; null if it is blank."""
    return F.nullif(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[^0-9A-Za-z\-._]", "_"), F.lit(""))


def _stated(attributes: DataFrame) -> DataFrame:
    """(table_id, r, c, above): at each attribute cell (table_id, r, c, name, text), the last one of each name up to it, in the order of their rows.

    So a row inherits as many as there are names, and not all cells above it.
    """
    names = attributes.select("table_id", "c", "name").distinct()
    every = attributes.select("table_id", "r", "c", F.col("name").alias("__own"), "text").join(names, ["table_id", "c"])
    told = F.last(F.when(F.col("__own") == F.col("name"), F.struct("r", "name", "text")), ignorenulls=True)
    so_far = every.select("table_id", "r", "c", told.over(Window.partitionBy("table_id", "c", "name").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    return so_far.filter("x IS NOT NULL").groupBy("table_id", "r", "c").agg(F.array_sort(F.collect_list("x")).alias("above"))


def extract(cells: DataFrame, rows: DataFrame, columns: DataFrame, headers_in: DataFrame | None = None) -> DataFrame:
    """(table_id, r, c, value, header, name, attributes) of every cell with text in a data row and a data column.

    rows: (table_id, r, type), columns: (table_id, c, type), headers_in: (table_id, headers_in), row or
    column; row where it says nothing. header: the texts of the header rows in the cell's column, from
    the top, each once, joined by " / "; in all but the lowest an empty cell is the one on its left, as
    wide ones are. name: the same as an attribute's name. attributes: of the row's cells in
    attribute columns by these columns' headers (numbered from 1, if they have none), and of the cells above
    in the cell's column in attribute rows, by what these rows have in the last attribute column; rows without one are left
    out, and of equal names the lower row counts, then the right column.
    """
    if headers_in is not None:
        turned = headers_in.filter("headers_in = 'column'").select("table_id")
        swap = lambda df: df.join(turned, "table_id", "left_semi")
        rest = lambda df: df.join(turned, "table_id", "left_anti")
        upright = extract(rest(cells), rest(rows), rest(columns))
        flip = swap(cells).select("table_id", F.col("c").alias("r"), F.col("r").alias("c"), "text")
        lying = extract(flip, swap(columns).select("table_id", F.col("c").alias("r"), "type"), swap(rows).select("table_id", F.col("r").alias("c"), "type"))
        back = lying.select("table_id", F.col("c").alias("r"), F.col("r").alias("c"), "value", "header", "name", "attributes")
        return upright.unionByName(back)
    text = F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit(""))
    typed = cells.select("table_id", "r", "c", text.alias("text")).join(rows.select("table_id", "r", F.col("type").alias("of_row")), ["table_id", "r"]).join(columns.select("table_id", "c", F.col("type").alias("of_column")), ["table_id", "c"])
    heads = typed.filter("of_row = 'header'").withColumn("__low", F.max("r").over(Window.partitionBy("table_id")))
    left = F.last("text", ignorenulls=True).over(Window.partitionBy("table_id", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    heads = heads.withColumn("text", F.when(F.col("r") == F.col("__low"), F.col("text")).otherwise(left)).filter("text IS NOT NULL")
    path = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]))
    header = heads.groupBy("table_id", "c").agg(F.array_join(path, " / ").alias("header"))
    beside = typed.filter("of_row = 'data' AND of_column = 'attribute' AND text IS NOT NULL").join(header, ["table_id", "c"], "left")
    number = F.dense_rank().over(Window.partitionBy("table_id").orderBy("c")).cast("string")
    beside = beside.withColumn("__name", F.coalesce(attribute_name(F.col("header")), F.concat(F.lit("attribute"), number)))
    parallel = beside.groupBy("table_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", F.col("__name").alias("name"), "text"))).alias("parallel"))
    named = typed.filter("of_row = 'attribute' AND of_column = 'attribute'").groupBy("table_id", "r").agg(F.max_by("text", "c").alias("__t")).select("table_id", "r", attribute_name(F.col("__t")).alias("__row"))
    body = typed.filter("of_column = 'data' AND text IS NOT NULL")
    stated = _stated(body.filter("of_row = 'attribute'").join(named.filter("__row IS NOT NULL"), ["table_id", "r"]).select("table_id", "r", "c", F.col("__row").alias("name"), "text"))
    data = body.filter("of_row = 'data'").select("table_id", "r", "c", "text", "of_row")
    body = data.unionByName(stated, allowMissingColumns=True)
    body = body.withColumn("orthogonal", F.last("above", ignorenulls=True).over(Window.partitionBy("table_id", "c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)))
    body = body.filter("of_row = 'data'").drop("above")
    joined = body.join(parallel, ["table_id", "r"], "left").join(header, ["table_id", "c"], "left")
    none = lambda c: F.coalesce(F.transform(c, lambda x: F.struct(x["name"].alias("key"), x["text"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    every = F.concat(none(F.col("parallel")), none(F.col("orthogonal")))
    attributes = F.aggregate(every, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["key"]), F.create_map(x["key"], x["value"])))
    return joined.select("table_id", "r", "c", F.col("text").alias("value"), "header", attribute_name(F.col("header")).alias("name"), attributes.alias("attributes"))
