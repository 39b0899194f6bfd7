"""Lines, paragraphs and page numbers by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.operators import layout as ly
from marginalia.operators import paragraphs as pg


def block(spark, boxes, **more):
    """One block of lines (l, r, t, b), in the order given; more: further columns by line."""
    rows = [(1, k + 1, *b, *(c[k] for c in more.values())) for k, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "key int, line int, l int, r int, t int, b int" + "".join(f", {c} int" for c in more))
    return df.select("key", "line", ly.box(*(F.col(c) for c in "lrtb")).alias("box"), *more)


def paras(df):
    return [r.para for r in df.orderBy("line").collect()]


def test_three_fragments_out_of_order_are_one_line(spark):
    boxes = [(0, 300, 0, 12), (210, 300, 21, 33), (0, 90, 20, 32), (100, 200, 22, 34), (0, 300, 40, 52), (50, 60, 38, 42)]
    got = pg.merge_fragments(block(spark, boxes, baseline=[10, 31, 30, 0, 50, 40], font_size=[9, 9, 8, 10, 9, 5]), ["key"]).orderBy("line").collect()
    assert [(r.line, tuple(r.box), r.baseline, r.font_size) for r in got] == [(1, (0, 300, 0, 12), 10, 9), (2, (0, 300, 20, 34), 30, 9), (4, (0, 300, 40, 52), 50, 9)]  # the low one is dropped


def test_lines_that_lie_over_each_other_stay(spark):
    got = pg.merge_fragments(block(spark, [(0, 100, 0, 12), (50, 150, 2, 14), (160, 200, 1, 13), (0, 100, 11, 23)]), ["key"]).orderBy("line").collect()
    assert [tuple(r.box) for r in got] == [(0, 200, 0, 13), (50, 150, 2, 14), (0, 100, 11, 23)]


def starts(spark, lefts, para):
    return paras(pg.split_starts(block(spark, [(x, 400, 20 * k, 20 * k + 12) for k, x in enumerate(lefts)], para=para), ["key"], 300))


@pytest.mark.parametrize(
    ("lefts", "para", "want"),
    [
        ([0, 30, 0], [0, 0, 0], [0, 0, 0]),  # under four lines: none
        ([30, 0, 0, 30, 0, 0], [0] * 6, [0, 0, 0, 1, 1, 1]),  # two of six are indented: half as many as the others
        ([30, 0, 30, 0, 30, 0, 0], [0] * 7, [0] * 7),  # three of seven: too many for a short paragraph
        ([30, 0, 30, 0, 0, 30, 0, 0, 30, 0], [0] * 10, [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]),  # four of ten: two thirds do from ten lines on
        ([0, 30, 30, 0, 30, 30], [0] * 6, [0, 0, 0, 1, 1, 1]),  # exdents
        ([0, 10, 0, 10, 0, 10], [0] * 6, [0] * 6),  # under dpi / 20
        ([30, 0, 0, 30, 0, 30, 0, 30, 0, 0], [0, 0, 0, 1, 1, 2, 2, 2, 2, 2], [0, 0, 0, 1, 1, 2, 2, 3, 3, 3]),  # three paragraphs: by the mean first start
    ],
)
def test_starts(spark, lefts, para, want):
    assert starts(spark, lefts, para) == want


def test_starts_far_to_the_right_and_low_lines_do_not_count(spark):
    assert starts(spark, [30, 0, 0, 0, 30, 0, 0, 0, 390], [0] * 9) == [0, 0, 0, 0, 1, 1, 1, 1, 2]  # the last is nearer to the largest counted start


def margins(spark, gaps, para, dpi=300):
    tops = [sum(gaps[:k]) + 10 * k for k in range(len(gaps) + 1)]
    return paras(pg.split_margins(block(spark, [(0, 100, t, t + 10) for t in tops], para=para), ["key"], dpi))


def test_margins(spark):
    gaps = [2, 2, 30, 2, 2, 30, 2, 30, 2]
    assert margins(spark, gaps, [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert margins(spark, gaps, [0, 0, 0, 1, 1, 1, 1, 1, 1, 1]) == [0, 0, 0, 1, 1, 1, 1, 1, 1, 1]  # two paragraphs: none
    assert margins(spark, [2, 2, 14, 2, 2, 14, 2, 14, 2], [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]  # not over dpi / 20
    assert margins(spark, [2, 2, 14, 2, 2, 14, 2, 14, 2], [0, 0, 0, 1, 1, 1, 2, 2, 2, 2], 200) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_readings(spark):
    rows = [("l2", 0, True), ("S1", 25, True), ("l2", 0, False), ("12", 74, False), ("12", 26, True), ("12", 74, True), ("O5", 1, True), ("05", 1, True), ("x1", 1, True), ("123456", 1, True), ("o7", 2, True), ("", 3, True), (None, 4, True), ("lS", 99, True)]
    got = pg.page_readings(spark.createDataFrame([(1, 7, p, 100, s, o) for s, p, o in rows], "doc int, page int, pos int, size int, str string, ocred boolean")).collect()
    assert sorted((r.str, r.pos, r.value, r.fuzzy, r.ambiguity) for r in got) == [("12", 74, 12, 0, 1), ("12", 74, 12, 0, 1), ("O5", 1, 65, 1, 2), ("S1", 25, 51, 1, 2), ("S1", 25, 81, 1, 2), ("l2", 0, 12, 1, 2), ("l2", 0, 72, 1, 2), *(("lS", 99, v, 2, 4) for v in (15, 18, 75, 78))]
    best = pg.best_readings(spark.createDataFrame([(1, 1, 5, 0, 1, 12, 9), (1, 1, 6, 1, 2, 72, 20), (1, 2, 5, 2, 4, 13, 30), (1, 2, 6, 0, 1, 99, 5)], "doc int, page int, pos int, fuzzy int, ambiguity int, value int, score long"))
    assert {(r.page, r.value) for r in best.collect()} == {(1, 12), (2, 99)}
