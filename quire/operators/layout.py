"""Positioned words to lines, reading order and table grids.

Words are (doc_id, page, word, x0, x1, y, t). Every step works inside one page, so pages are the unit of
distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import line_arrays, page_tables

PAGE = ["doc_id", "page"]


def physical_lines(words: DataFrame, size: float = 10.0) -> DataFrame:
    """doc_id, page, line from 1, y, x0, x1, text: a line ends where y leaves that of its first word by more than max(2, .35 size)."""
    slack = max(2.0, 0.35 * size)
    w = words.dropna(subset=["y", "x0", "x1"]).select(*PAGE, *[F.col(c).cast("double").alias(c) for c in ("y", "x0", "x1")], F.col("word").cast("long").alias("word"), "t")
    page = ", ".join(f"{c} {kind}" for c, kind in w.dtypes[:2])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield line_arrays.packed_words(batch)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, columns = line_arrays.page_lines(line_arrays.unpacked_words(batch.column(2)), slack)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[:2]), *columns], [*PAGE, "line", "y", "x0", "x1", "text"])

    # the only shuffle of the words, of which a page's stand together in few bytes
    pages = w.mapInArrow(packed, f"{page}, words binary").groupBy(*PAGE).agg(F.collect_list("words").alias("words"))
    return pages.mapInArrow(part, f"{page}, line int, y double, x0 double, x1 double, text string")


def reading_order(blocks: DataFrame, width: float) -> DataFrame:
    """Blocks (doc_id, page, block, x0, y0, x1, y1) with `order` from 1.

    A page has two columns if it has three blocks or more in either half; there, what spans both and stands above
    them comes first, then the left column, the right one, and what spans both below.
    """
    mid = width / 2
    side = F.when(F.col("x1") <= mid + 5, "left").when(F.col("x0") >= mid - 5, "right").otherwise("span")
    b = blocks.withColumn("_side", side)
    page = Window.partitionBy(*PAGE)
    n = lambda s: F.sum((F.col("_side") == s).cast("int")).over(page)
    top = F.min(F.when(F.col("_side") != "span", F.col("y0"))).over(page)
    b = b.withColumns({"_two": (n("left") >= 3) & (n("right") >= 3), "_top": top})
    zone = F.when(~F.col("_two"), 0).when((F.col("_side") == "span") & (F.col("y0") <= F.col("_top")), 1).when(F.col("_side") == "left", 2).when(F.col("_side") == "right", 3).otherwise(4)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy(zone, F.round("y0", 1), "x0", "block"))
    return b.withColumn("order", order).drop("_side", "_two", "_top")


def nearest_caption(regions: DataFrame, captions: DataFrame, reach: float = 40.0, slack: float = 4.0) -> DataFrame:
    """Each region (doc_id, page, region, x0, x1, top, bottom) with the text of the lowest caption that stands within
    reach above or below and overlaps it in x; a join by page with the ranges as its condition."""
    c = captions.select("doc_id", "page", F.col("text").alias("caption"), F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("y0").alias("cy"))
    near = F.col("cy").between(F.col("top") - reach, F.col("top") + slack) | F.col("cy").between(F.col("bottom") - slack, F.col("bottom") + reach)
    j = regions.join(c, PAGE).filter(near & (F.col("cx0") < F.col("x1")) & (F.col("cx1") > F.col("x0")))
    best = j.groupBy("doc_id", "page", "region").agg(F.max_by("caption", F.struct("cy", "caption")).alias("caption"))
    return regions.join(best, ["doc_id", "page", "region"], "left")


def regions_of_rules(rules: DataFrame, least_gap: float = 8.0, least_height: float = 15.0) -> DataFrame:
    """Horizontal rules (doc_id, page, y, x0, x1) of the same ends to regions: doc_id, page, region, x0, x1, top, bottom, rules."""
    g = rules.groupBy("doc_id", "page", "x0", "x1").agg(F.sort_array(F.collect_set("y")).alias("ys"))
    g = g.withColumn("ys", F.filter("ys", lambda y, i: (i == 0) | (y - F.get("ys", i - 1) >= least_gap)))
    g = g.filter((F.size("ys") >= 2) & (F.element_at("ys", -1) - F.get("ys", F.lit(0)) >= least_height))
    w = Window.partitionBy(*PAGE).orderBy(F.get("ys", F.lit(0)), "x0")
    return g.select("doc_id", "page", F.row_number().over(w).alias("region"), "x0", "x1", F.get("ys", F.lit(0)).alias("top"), F.element_at("ys", -1).alias("bottom"), F.size("ys").alias("rules"))


def grids(words: DataFrame, regions: DataFrame, size: float = 10.0) -> DataFrame:
    """Words inside each region to a grid: doc_id, page, region, row, cells (array of strings, one a column; '' under a wide cell).

    Columns are parted by corridors of x that nearly all lines leave free between two words; without any, by the line of most words.
    """
    inside = words.join(regions.select("doc_id", "page", "region", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), "top", "bottom"), PAGE)
    inside = inside.filter(F.col("y").between(F.col("top"), F.col("bottom")) & (F.col("x0") >= F.col("rx0") - 2) & (F.col("x1") <= F.col("rx1") + 2))
    key = ["doc_id", "page", "region"]
    words_of = F.sort_array(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "t")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = line_arrays.lines_of_words(batch.column(3), max(2.0, 0.35 * size))
            yield from _grid_rows(batch, lines)

    kinds = dict(inside.dtypes)
    return inside.groupBy(*key).agg(words_of.alias("_w")).mapInArrow(rows, ", ".join(f"{c} {kinds[c]}" for c in key) + ", row int, cells array<string>")


def _grid_rows(batch: pa.RecordBatch, lines: line_arrays.Lines) -> Iterator[pa.RecordBatch]:
    """A row for each line of the regions that have columns: its cells' texts, '' where none begins."""
    at, bounds = line_arrays.column_bounds(lines, page_tables.CORRIDOR_SHARE, page_tables.CORRIDOR_WIDTH, page_tables.OUTER_PAD)
    at, a, b = line_arrays.slots(at, bounds)
    n = np.diff(at)
    region = line_arrays.owners(lines.regions)
    line, first, text = line_arrays.cells(lines, at, a, b)
    places = line_arrays.offsets(n[region])
    held = np.full(places[-1], -1, np.int64)
    in_slots = np.flatnonzero(n[region[line]] > 0)
    held[places[line[in_slots]] + first[in_slots]] = in_slots
    texts = pc.fill_null(text.take(pa.array(held, mask=held < 0)), "")
    row = np.arange(len(region)) - lines.regions[region] + 1
    made = pa.RecordBatch.from_arrays([*(c.take(pa.array(region)) for c in batch.columns[:3]), pa.array(row, pa.int32()), line_arrays.listed(places, texts)], ["doc_id", "page", "region", "row", "cells"])
    yield made.filter(pa.array(n[region] > 0))


def laid_out(paragraphs: DataFrame, lines: int = 40, char: float = 6.0, leading: float = 12.0) -> DataFrame:
    """Paragraphs as words at the places that a fixed-width page would give them; a page has so many paragraphs. Nothing is shuffled."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column(2), " ")
            at, t = line_arrays.starts(words), words.flatten()
            size = pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
            own = line_arrays.owners(at)
            reach = line_arrays.offsets(size + 1)
            x0 = (reach[:-1] - reach[at[:-1]][own]) * char
            word = np.arange(len(own)) - at[:-1][own]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in batch.columns[:2]), pa.array(word), pa.array(x0), pa.array(x0 + size * char), t], ["doc_id", "pos", "word", "x0", "x1", "t"])

    p = paragraphs.select("doc_id", F.col("pos").cast("int").alias("pos"), "text")
    w = p.mapInArrow(part, f"doc_id {dict(p.dtypes)['doc_id']}, pos int, word long, x0 double, x1 double, t string")
    return w.select("doc_id", (F.floor((F.col("pos") - 1) / lines) + 1).cast("int").alias("page"), (F.col("pos").cast("long") * 100_000 + F.col("word")).alias("word"), "x0", "x1", (F.pmod(F.col("pos") - 1, F.lit(lines)) * leading).alias("y"), "t")
