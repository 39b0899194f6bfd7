"""Extraction from tables by hand."""

from __future__ import annotations

from marginalia.operators import extraction as ex

TABLE = [
    ["", "", "Length", "", "Width"],
    ["Site", "Note", "male", "female", "male"],
    ["A", "x", "1", "2", "3"],
    ["unit", "", "mm", "cm", ""],
    ["B", "", "4", "", "6"],
    ["C", "y z", "7", "8", "9"],
]


def cells(spark, *tables):
    return spark.createDataFrame([(t, r, c, x) for t, rows in enumerate(tables) for r, row in enumerate(rows) for c, x in enumerate(row)], "table_id int, r int, c int, text string")


def told(df):
    return {(r.table_id, r.r, r.c): (r.value, r.header, r.attributes) for r in df.collect()}


def types(spark, rows, columns, tables=1):
    one = lambda values, k: spark.createDataFrame([(t, i, x) for t in range(tables) for i, x in enumerate(values)], f"table_id int, {k} int, type string")
    return one(rows, "r"), one(columns, "c")


ROWS, COLUMNS = ["header", "header", "data", "attribute", "data", "data"], ["attribute", "attribute", "data", "data", "data"]
WANT = {
    (2, 2): ("1", "Length / male", {"Site": "A", "Note": "x"}),
    (2, 3): ("2", "Length / female", {"Site": "A", "Note": "x"}),
    (2, 4): ("3", "Width / male", {"Site": "A", "Note": "x"}),
    (4, 2): ("4", "Length / male", {"Site": "B", "unit": "mm"}),
    (4, 4): ("6", "Width / male", {"Site": "B"}),
    (5, 2): ("7", "Length / male", {"Site": "C", "Note": "y z", "unit": "mm"}),
    (5, 3): ("8", "Length / female", {"Site": "C", "Note": "y z", "unit": "cm"}),
    (5, 4): ("9", "Width / male", {"Site": "C", "Note": "y z"}),
}


def test_two_header_rows_and_attributes_of_both_directions(spark):
    table = [[x if (r, c) != (3, 1) else "unit" for c, x in enumerate(row)] for r, row in enumerate(TABLE)]
    assert told(ex.extract(cells(spark, table), *types(spark, ROWS, COLUMNS))) == {(0, *k): v for k, v in WANT.items()}
    # the last attribute column names an attribute row; without a name there it is left out
    got = told(ex.extract(cells(spark, TABLE), *types(spark, ROWS, COLUMNS)))
    assert got[0, 5, 2][2] == {"Site": "C", "Note": "y z"}


def test_headers_in_a_column(spark):
    table = [[x if (r, c) != (3, 1) else "unit" for c, x in enumerate(row)] for r, row in enumerate(TABLE)]
    turned = [list(x) for x in zip(*table, strict=True)]
    both = spark.createDataFrame([(0, r, c, x) for r, row in enumerate(turned) for c, x in enumerate(row)] + [(1, r, c, x) for r, row in enumerate(table) for c, x in enumerate(row)], "table_id int, r int, c int, text string")
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(COLUMNS)] + [(1, i, x) for i, x in enumerate(ROWS)], "table_id int, r int, type string")
    columns = spark.createDataFrame([(0, i, x) for i, x in enumerate(ROWS)] + [(1, i, x) for i, x in enumerate(COLUMNS)], "table_id int, c int, type string")
    where = spark.createDataFrame([(0, "column"), (1, "row")], "table_id int, headers_in string")
    assert told(ex.extract(both, rows, columns, where)) == {(0, c, r): v for (r, c), v in WANT.items()} | {(1, *k): v for k, v in WANT.items()}


def test_types(spark):
    table = [["Site", "Length", ""], ["A", "1", ""], ["unit", "mm", ""], ["", "", ""], ["B", "x 2", "3"]]
    got = {r.r: r.type for r in ex.line_types(cells(spark, table)).collect()}
    assert got == {0: "header", 1: "data", 2: "attribute", 3: "empty", 4: "data"}
    across = {r.c: r.type for r in ex.line_types(cells(spark, table), "c", "r").collect()}
    assert across == {0: "header", 1: "data", 2: "data"}


def test_columns_without_headers_and_empty_tables(spark):
    got = told(ex.extract(cells(spark, [["a", "1"], ["a", "2"]]), *types(spark, ["data", "data"], ["attribute", "data"])))
    assert got == {(0, 0, 1): ("1", None, {"attribute1": "a"}), (0, 1, 1): ("2", None, {"attribute1": "a"})}
    assert ex.extract(cells(spark), *types(spark, ROWS, COLUMNS)).count() == 0
