"""Work that grows with the tables and not with the square of a group: rows that plans make, on small tables with large groups."""

from __future__ import annotations

import random
from collections import Counter

from marginalia.operators import dates
from marginalia.operators import repair as rp
from marginalia.operators.extraction import extract
from marginalia.operators.tables import grid
from marginalia.plans import catalogue, refs, text


def rows_made(df, metric="numOutputRows"):
    """The rows of the result, and the most rows (or bytes, with dataSize) that any node of its plan put out."""
    got = df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        count = node.metrics().get(metric)
        most = max(most, count.get().value() if count.isDefined() else 0)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return got, most


def flora_of(spark, n):
    """n genera, each with a species sp and a subspecies that wants it."""
    columns = "id string, parent string, valid string, rank string, epithet string, prefix string, name string, genus string, species string, below string"
    rows = [(f"g{k}", None, None, "genus", f"G{k}", None, None, None, None, None) for k in range(n)]
    rows += [(f"s{k}", f"g{k}", None, "species", "sp", None, None, None, None, None) for k in range(n)]
    rows += [(f"x{k}", f"g{k}", None, "subSpecies", "low", f"G{k} sp", None, None, "sp", "low") for k in range(n)]
    rows += [(f"t{k}", f"g{k}", None, "species", "sp f. low", f"G{k}", None, None, None, None) for k in range(n)]
    return spark.createDataFrame(rows, columns)


def test_records_of_one_name_make_no_pairs(spark):
    n = 600
    flora = flora_of(spark, n)
    for repaired in (rp.reattached(rp.fitted(flora)), rp.promoted(rp.reattached(rp.fitted(flora))), rp.rehung(flora)):
        got, most = rows_made(repaired)
        assert {r.id: r.parent for r in got if r.id[0] == "x"} == {f"x{k}": f"s{k}" for k in range(n)}
        assert most < 20 * n
    got, most = rows_made(rp.split_species(flora))
    assert {(r.id, r.parent, r.rank) for r in got if r.id[0] == "t"} == {(f"t{k}", f"s{k}", "form") for k in range(n)}
    assert most < 20 * n


def test_the_nearest_of_a_name_that_is_not_the_record_itself(spark):
    up = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("w", "a")], "desc string, anc string")
    records = spark.createDataFrame([(i, "species", "sp") for i in "acdw"] + [("b", "genus", "G")], "id string, rank string, epithet string")
    wanted = spark.createDataFrame([("w", "a", "species", "sp"), ("a", "a", "species", "sp"), ("y", "b", "species", "sp"), ("z", "c", "species", "sp"), ("c", "c", "species", "sp"), ("n", "b", "species", "no")], "id string, top string, rank string, epithet string")
    assert {tuple(r) for r in rp._found(up, records, wanted).collect()} == {("w", "a"), ("a", "w"), ("y", "c"), ("z", "c")}


def test_a_filter_on_attributes_reads_xml_once(spark, small):
    df = refs.through_attributes(spark, small)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1


def test_attributes_of_one_name_are_not_all_carried(spark):
    n = 2000
    texts = [(1, r, c, "Head" if r == 0 else f"k{r % 4}" if c == 0 else f"t{r}") for r in range(n) for c in range(2)]
    cells = spark.createDataFrame(texts, "table_id int, r int, c int, text string")
    rows = spark.createDataFrame([(1, r, "header" if r == 0 else "attribute" if r % 2 else "data") for r in range(n)], "table_id int, r int, type string")
    columns = spark.createDataFrame([(1, 0, "attribute"), (1, 1, "data")], "table_id int, c int, type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, moved = rows_made(extract(cells, rows, columns), "dataSize")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    last = {r.r: r.attributes for r in got}
    assert len(last) == n // 2 - 1 and last[2] == {"Head": "k2", "k1": "t1"} and last[1998] == {"Head": "k2", "k3": "t1995", "k1": "t1997"}
    assert moved < 2_000_000


def filled(t):
    """A table's places by brute force, all spans laid out: {(r, c): (text, spanned)}."""
    rows = [[x for x in t if x[2] == r] for r in sorted({x[2] for x in t})]
    width, taken = max(sum(x[4] for x in row) for row in rows), {}
    for r, row in enumerate(rows):
        c = 0
        for _, _, _, _, wide, high, text in sorted(row, key=lambda x: x[3]):
            while (r, c) in taken:
                c += 1
            for i in range(1 if wide >= width else high):
                for j in range(wide):
                    if c + j < width and r + i < len(rows):
                        taken[r + i, c + j] = (text, bool(i or j))
            c += wide
    return {(r, c): taken.get((r, c), ("", None)) for r in range(len(rows)) for c in range(width)}


def test_a_grid_is_streamed_and_fills_spans(spark):
    dice = random.Random(7)
    cells = [(t, "body", r, k, dice.choice((1, 1, 2, 3)), dice.choice((1, 1, 2, 5)), f"{t}.{r}.{k}") for t in range(20) for r in range(dice.randint(1, 30)) for k in range(dice.randint(1, 4))]
    df = grid(spark.createDataFrame(cells, "table_id long, sec string, r int, ord int, colspan int, rowspan int, text string"))
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()  # a whole table as one batch
    got = {}
    for x in df.collect():
        got.setdefault(x.table_id, {})[x.r, x.c] = (x.text, x.spanned)
    assert got == {t: filled([x for x in cells if x[0] == t]) for t in range(20)}


def test_spans_are_found_once_to_be_compared(spark):
    rows = [(1, 0, 3, 4), (1, 0, 3, 4), (1, 2, 5, 0), (1, 3, 5, 0), (1, 2, 6, 4), (2, 2, 5, 0), (3, 0, 2, None), (3, 1, 3, 4), (None, 0, 3, 4), (None, 1, 2, 0)]
    df = dates.resolve_by_year(spark.createDataFrame(rows, "doc_id long, start int, end int, year_len int"))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert Counter(map(tuple, df.collect())) == Counter([(1, 0, 3, 4), (1, 2, 6, 4), (2, 2, 5, 0), (3, 0, 2, None), (3, 1, 3, 4), (None, 0, 3, 4), (None, 1, 2, 0)])


def test_the_term_profile_shuffles_counts_and_not_tokens(spark, tmp_path):
    rows = [(k, "to be or not to be " * 200, "en", "s", 1) for k in range(50)] + [(50, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, moved = rows_made(text.profile(spark, str(tmp_path)), "shuffleRecordsWritten")
    assert {(r.term, r.n, r.successor) for r in got} == {("to", 20000, "be"), ("be", 20000, "or"), ("or", 10000, "not"), ("not", 10000, "to")}
    assert moved < 1000


def test_records_as_json_do_not_parse_tiles_again(spark, small):
    plan = catalogue.QUERIES["s12_by_id_expanded"][0](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "] text" not in plan
