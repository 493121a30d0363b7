"""Lines, columns and cells on arrays against plain versions, and regions of many lines."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import layout, line_arrays
from quire.operators import page_tables as pt

WORDS = "doc_id long, page int, x0 double, x1 double, y double, t string"


def plain_lines(words, slack):
    lines = []
    for y, x0, x1, t in sorted(words):
        if not lines or y - lines[-1][0] > slack:
            lines.append((y, []))
        lines[-1][1].append((x0, x1, t))
    return [(y, sorted(ws)) for y, ws in lines]


def test_lines():
    rng = random.Random(3)
    lists = [[(rng.choice([0.0, 1.0, 2.5, 4.0, 7.5, 20.0, 21.0, 22.0, 23.0, 24.5]), float(x := rng.randint(0, 4)), x + 5.0, rng.choice("abcé")) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    kind = pa.list_(pa.struct([("y", pa.float64()), ("x0", pa.float64()), ("x1", pa.float64()), ("t", pa.string())]))
    a = pa.array([[dict(zip(("y", "x0", "x1", "t"), w, strict=True)) for w in sorted(ws)] for ws in lists], kind)
    for part in (a, a[5:90], a[:0]):
        got = line_arrays.as_lists(line_arrays.lines_of_words(part, 3.5)).to_pylist()
        want = [plain_lines([tuple(w.values()) for w in ws], 3.5) for ws in part.to_pylist()]
        assert [[(x["y"], [tuple(w.values()) for w in x["words"]]) for x in lines] for lines in got] == want
        assert line_arrays.as_lists(line_arrays.lines_of_lists(line_arrays.as_lists(line_arrays.lines_of_words(part, 3.5)))).to_pylist() == got


@pytest.fixture
def long_page(spark):
    """4,000 lines of three words on a page, beside a page of one word without a width."""
    page = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page"), (F.col("id") * 12.0).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    page = page.select("doc_id", "page", (F.col("k") * 100.0).alias("x0"), (F.col("k") * 100.0 + 10).alias("x1"), "y", F.concat(F.lit("w"), F.col("k").cast("string")).alias("t"))
    return page.unionByName(spark.createDataFrame([(2, 1, 5.0, 5.0, 3.0, "dot")], WORDS))


def test_grid_of_many_lines(spark, long_page):
    regions = spark.createDataFrame([(d, 1, 1, 0.0, 300.0, 0.0, 1e6) for d in (1, 2)], "doc_id long, page int, region int, x0 double, x1 double, top double, bottom double")
    began = time.time()
    got = layout.grids(long_page, regions).collect()
    assert time.time() - began < 30  # minutes, when each word looked at each line
    assert sorted(g.row for g in got) == list(range(1, 4001)) and {tuple(g.cells) for g in got} == {("w0", "w1", "w2")} and {g.doc_id for g in got} == {1}


def test_slots_of_many_lines(spark, long_page):
    regions = spark.createDataFrame([(1, 1, 1, -10.0, 1000.0, [0.0, 1e6])], "doc_id long, page int, region int, x0 double, x1 double, ys array<double>")
    began = time.time()
    (got,) = pt.slots_of_lines(pt.region_lines(regions, long_page)).collect()
    assert time.time() - began < 30
    assert [tuple(s) for s in got.slots] == [(-8.0, 55.5), (55.5, 155.5), (155.5, 218.0)]


def test_words_over_columns(spark):
    """A wide word and words without text in a grid."""
    rows = [(1, 1, 100.0 * k, 100.0 * k + 10, 12.0 * y, f"{y}{k}") for y in range(20) for k in range(3)] + [(1, 1, 0.0, 110.0, 240.0, "wide"), (1, 1, 112.0, 118.0, 240.0, "on"), (1, 1, 200.0, 204.0, 240.0, None), (1, 1, 205.0, 210.0, 240.0, "z")]
    regions = spark.createDataFrame([(1, 1, 1, 0.0, 300.0, 0.0, 1e6)], "doc_id long, page int, region int, x0 double, x1 double, top double, bottom double")
    got = {g.row: g.cells for g in layout.grids(spark.createDataFrame(rows, WORDS), regions).collect()}
    assert got[1] == ["00", "01", "02"] and got[21] == ["wide on", "", "z"]
