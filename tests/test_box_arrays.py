"""Boxed tables on arrays: a page of very many boxes, heights that are halves, drawings without all their sides."""

import time

from pyspark.sql import functions as F

from quire.operators import page_tables as pt

DRAWN, WORDS = "doc_id long, page int, x0 double, x1 double, y0 double, y1 double", "doc_id long, page int, x0 double, x1 double, y double, t string"


def test_many_boxes_on_a_page(spark):
    n = 250
    at = spark.range(n * n).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % n * 20.0).alias("x"), (F.floor(F.col("id") / n) * 10.0).alias("y"), F.col("id").cast("string").alias("t"))
    boxes = at.select("doc_id", "page", F.col("x").alias("x0"), (F.col("x") + 20).alias("x1"), F.col("y").alias("y0"), (F.col("y") + 10).alias("y1"))
    words = at.select("doc_id", "page", (F.col("x") + 2).alias("x0"), (F.col("x") + 12).alias("x1"), (F.col("y") + 4).alias("y"), "t")
    began = time.time()
    (got,) = pt.boxed_tables(boxes, words).select("columns", F.transform("rows", lambda r: F.transform(r, lambda c: c["text"])).alias("rows")).collect()
    assert time.time() - began < 40  # minutes, when each cell met each word of its page
    assert got.columns == n and got.rows == [[str(n * r + c) for c in range(n)] for r in range(n)]


def test_two_tables_and_missing_sides(spark):
    """Ends at half points round away from zero; a drawing without a side is none; the lower table comes second."""
    boxes = [(1, 1, 10.0, 60.0, y, y + 20) for y in (10.5, 30.5)] + [(1, 1, 10.0, 60.0, y, y + 20) for y in (200.0, 220.0)] + [(1, 1, None, 60.0, 90.0, 110.0)]
    words = [(1, 1, 12.0, 20.0, y, t) for y, t in ((15.0, "a"), (40.0, "b"), (205.0, "c"), (225.0, "d"), (228.0, "d2"), (95.0, "e"))] + [(1, 1, 12.0, 20.0, None, "f")]
    got = pt.boxed_tables(spark.createDataFrame(boxes, DRAWN), spark.createDataFrame(words, WORDS)).orderBy("region").collect()
    assert [(g.region, g.y0, g.y1, [[c.text for c in r] for r in g.rows]) for g in got] == [(1, 11.0, 51.0, [["a"], ["b"]]), (2, 200.0, 240.0, [["c"], ["d d2"]])]
