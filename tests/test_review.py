"""Figures, headers, author rows, replies and zones on small cases, nulls, ties and empty tables among them."""

from pyspark.sql import functions as F

from quire.functions import mathtext
from quire.operators import figures, layout, review, structured


def test_headers(spark):
    rows = [(1, 1, 1, 1, 0, 1, "Model"), (1, 1, 1, 1, 1, 2, "Perplexity"), (1, 1, 1, 2, 1, 1, "(lower is"), (1, 1, 1, 2, 1, 2, "better)"), (1, 1, 1, 3, 1, 1, "Float"), (1, 1, 1, 3, 2, 1, "Fixed"), (2, 1, 1, 1, 0, 1, "Time"), (2, 1, 1, 2, 0, 1, "(s)")]
    d = spark.createDataFrame(rows, "doc_id long, page int, region int, line int, start int, span int, text string")
    got = sorted((r.doc_id, r.row, r.start, r.span, r.text) for r in figures.headers(d).collect())
    assert got == [(1, 1, 0, 1, "Model"), (1, 1, 1, 2, "Perplexity better) (lower is"), (1, 2, 1, 1, "Float"), (1, 2, 2, 1, "Fixed"), (2, 1, 0, 1, "Time (s)")]
    assert figures.headers(d.limit(0)).count() == 0


def test_figure_areas(spark):
    c = spark.createDataFrame([(1, 1, "Figure 1", 0.0, 100.0, 200.0, 210.0), (1, 1, "Figure 2", 0.0, 100.0, 400.0, 410.0), (2, 1, "Figure 1", 0.0, 100.0, 200.0, 210.0)], "doc_id long, page int, caption string, x0 double, x1 double, y0 double, y1 double")
    b = spark.createDataFrame([(1, 1, 10.0, 120.0, 300.0, 390.0), (1, 1, 10.0, 90.0, 150.0, 195.0), (1, 1, 10.0, 90.0, 20.0, 60.0)], "doc_id long, page int, x0 double, x1 double, y0 double, y1 double")
    areas = figures.figure_areas(c, b)
    got = sorted(tuple(r) for r in areas.collect())
    assert got == [(1, 1, "Figure 1", 0.0, 100.0, 150.0, 198.0), (1, 1, "Figure 2", 0.0, 120.0, 300.0, 398.0), (2, 1, "Figure 1", 0.0, 100.0, 200.0, 198.0)]
    blocks = spark.createDataFrame([(1, 1, 1, "0.5", "text", 20.0, 30.0, 310.0, 315.0), (1, 1, 2, "Head", "heading", 20.0, 30.0, 320.0, 325.0), (1, 1, 3, None, "text", 20.0, 30.0, 320.0, 325.0)], "doc_id long, page int, block int, text string, kind string, x0 double, x1 double, y0 double, y1 double")
    assert [tuple(r) for r in figures.absorb_labels(areas, blocks).collect()] == [(1, 1, "Figure 2", ["0.5"])]


def test_author_rows(spark):
    rows = [(1, 1, "A\nX", 2, 0.0, 50.0, 10.0, 20.0), (1, 2, "B", 1, 60.0, 90.0, 11.0, 20.0), (1, 3, "C", 1, 300.0, 320.0, 11.0, 20.0), (1, 4, "low", 1, 0.0, 50.0, 900.0, 910.0)]
    d = spark.createDataFrame(rows, "doc_id long, block int, text string, lines int, x0 double, x1 double, y0 double, y1 double")
    assert [(r.row, r.text, r.blocks) for r in figures.author_rows(d, 1000.0).orderBy("row").collect()] == [(1, "A (X), B", 2), (2, "C", 1)]


def test_grids_without_a_corridor(spark):
    words = [(1, 1, 0, 0.0, 20.0, 10.0, "a"), (1, 1, 1, 20.0, 40.0, 10.0, "b"), (1, 1, 2, 0.0, 40.0, 22.0, "wide")]
    w = spark.createDataFrame(words, "doc_id long, page int, word int, x0 double, x1 double, y double, t string")
    r = spark.createDataFrame([(1, 1, 1, 0.0, 40.0, 0.0, 50.0)], "doc_id long, page int, region int, x0 double, x1 double, top double, bottom double")
    assert [x.cells for x in layout.grids(w, r).orderBy("row").collect()] == [["a", "b"], ["wide", ""]]
    assert layout.grids(w.limit(0), r).count() == 0


def test_formulas_in_long_texts(spark):
    """A text of a million characters needs no deep stack, with and without a closing mark."""
    d = spark.createDataFrame([("$" + "x " * 500_000,), ("word " * 200_000 + r"$a\$b$",), ("",), (None,)], "x string")
    got = d.select(F.size(review.split_math(F.col("x"))).alias("n"), review.equation_cell(F.col("x")).alias("e"), F.col("x").rlike(structured.PROSE).alias("p")).collect()
    assert [r.n for r in got][:3] == [1, 2, 0] and [r.e.boxed for r in got][:3] == [False, False, False] and got[1].p
    assert d.select(mathtext.unescaped_dollars(F.col("x")).alias("n")).collect()[1].n == 2


def test_replies_and_zones(spark):
    d = spark.createDataFrame([('{"zh": " ", "translation": "x"}',), ('{"target": "y"}',), ("cut {",), (None,)], "r string")
    assert [r.t for r in d.select(review.reply_text(F.col("r")).alias("t")).collect()] == ["x", "y", None, None]
    b = spark.createDataFrame([(1, "Page 1", 1.0, 5.0), (1, "Page 2", 96.0, 99.0), (1, "12", 1.0, 3.0), (1, "once", 1.0, 3.0), (1, "Page 3", 50.0, 55.0), (1, None, 1.0, 2.0)], "doc_id long, text string, y0 double, y1 double")
    assert sorted(r.text for r in review.zone_furniture(b, 100.0).collect()) == ["12", "Page 1", "Page 2"]


def test_stale(spark):
    d = spark.createDataFrame([(["if x", "a b c d"], ["if x", "译"]), (["if x", "a b c d"], ["if x", "a b c d"]), (["if"], ["a", "b"]), (["if"], None), (None, None)], "l array<string>, r array<string>")
    assert [r.s for r in d.select(structured.stale_algorithm(F.col("l"), F.col("r")).alias("s")).collect()] == [False, True, True, False, False]
