"""Tables, algorithms and figures of pages, from words, drawings and captions.

words: doc_id, page, x0, x1, y, t. drawings: doc_id, page, x0, x1, y0, y1. captions: doc_id, page, text, x0, x1, y0,
y1. blocks: doc_id, page, block, text, x0, x1, y0, y1. Everything meets by page, and by place within it; what
follows one region's lines works on the array of lines in its row. Heights of words count to a tenth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.predicates import caption_kind, figure_label, pseudocode_score
from quire.functions.text import normal
from quire.operators import box_arrays, grids, line_arrays, structured
from quire.operators.figures import figure_areas
from quire.sources.tables import stored

PAGE, REGION = ["doc_id", "page"], ["doc_id", "page", "region"]
WORD = "struct<x0:double,x1:double,t:string>"
LINE = f"struct<y:double,words:array<{WORD}>>"
CELLS = "array<struct<text:string,start:int,span:int>>"
BOX = ["x0", "x1", "y0", "y1"]

#: Fixed values, in points: rules closer than this belong together; the least height of a region; how far its words may stand outside.
NEAR_RULES, LEAST_HEIGHT, BETWEEN_PAD, SIDE_PAD, TOP_PAD, BOTTOM_PAD = 8.0, 15.0, 4.0, 6.0, 3.0, 9.0
#: The share of lines that a corridor must be free in, its least width, what is added at the outer slots, the least words of a region.
CORRIDOR_SHARE, CORRIDOR_WIDTH, OUTER_PAD, LEAST_WORDS = 0.9, 3, 8.0, 4
#: The score and lines of pseudocode; a caption's reach above and below and the slack at the edge.
PSEUDOCODE_SCORE, PSEUDOCODE_LINES, CAPTION_REACH, CAPTION_SLACK = 4, 3, 40.0, 4.0
#: How far a figure grows over labels in all, the most gap to the next label, the slack at its top.
GROW_REACH, GROW_GAP, GROW_SLACK = 80.0, 18.0, 2.0


def _slack(size: float) -> float:
    return max(2.0, 0.35 * size)


def text_of(line: Column) -> Column:
    return F.array_join(F.transform(line["words"], lambda w: w["t"]), " ")


def lines_of(words: Column, slack: float) -> Column:
    """Words (y, x0, x1, t), sorted, as lines: one ends where y leaves that of its first word by more than slack.

    One pass finds the places where lines begin, a line is the slice up to the next.
    """
    state = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, w: Column) -> Column:
        begins = F.struct(w["y"].alias("y"), (a["i"] + 1).alias("i"), F.concat(a["at"], F.array(a["i"] + 1)).alias("at"))
        goes_on = F.struct(a["y"].alias("y"), (a["i"] + 1).alias("i"), a["at"].alias("at"))
        return F.when(a["y"].isNull() | (w["y"] - a["y"] > slack), begins).otherwise(goes_on)

    bare = lambda ws: F.sort_array(F.transform(ws, lambda w: F.struct(w["x0"].alias("x0"), w["x1"].alias("x1"), w["t"].alias("t"))))
    line = lambda own: F.struct(F.get(own, F.lit(0))["y"].alias("y"), bare(own).alias("words"))
    cut = lambda ws, at: F.transform(at, lambda k, n: grids.let(F.slice(ws, k, F.coalesce(F.get(at, n + 1), F.size(ws) + 1) - k), line))
    return grids.let(words, lambda ws: grids.let(F.aggregate(ws, state, step, lambda a: a["at"]), lambda at: cut(ws, at))).cast(f"array<{LINE}>")


def _words(words: DataFrame) -> DataFrame:
    return words.select(*PAGE, F.struct(F.round(F.col("y").cast("double"), 1).alias("y"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "t").alias("w"))


def _collected() -> Column:
    return F.sort_array(F.collect_list("w"))


def table_regions(rules: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page, region, x0, x1, ys: rules (doc_id, page, y, x0, x1) of the same ends, parted where only captions or nothing lies between two."""
    ends = [*PAGE, "x0", "x1"]
    down = Window.partitionBy(*ends).orderBy("y")
    r = rules.select(*ends, "y").distinct().withColumn("_above", F.lag("y").over(down))
    apart = r.filter(F.col("y") - F.col("_above") >= NEAR_RULES)
    inside = F.col("w.x0").between(F.col("x0") - BETWEEN_PAD, F.col("x1") + BETWEEN_PAD) & (F.col("w.y") > F.col("_above") + 1) & (F.col("w.y") < F.col("y") - 1)
    between = apart.join(_words(words), PAGE).filter(inside).groupBy(*ends, "y").agg(_collected().alias("_w"))
    between = between.select(*ends, "y", F.exists(lines_of(F.col("_w"), 3.0), lambda line: caption_kind(text_of(line)).isNull()).alias("_text"))
    r = r.join(between, [*ends, "y"], "left")
    cut = (F.col("y") - F.col("_above") >= NEAR_RULES) & ~F.coalesce("_text", F.lit(False))
    r = r.withColumn("_part", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(down))
    g = r.groupBy(*ends, "_part").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    g = g.filter((F.size("ys") >= 2) & (F.element_at("ys", -1) - F.get("ys", F.lit(0)) >= LEAST_HEIGHT))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.get("ys", F.lit(0)), "x0", "x1"))
    return g.select(*PAGE, order.alias("region"), "x0", "x1", "ys")


def region_lines(regions: DataFrame, words: DataFrame, size: float = 10.0) -> DataFrame:
    """regions of LEAST_WORDS words or more with `lines` (y, words); words may stand a little outside the rules."""
    top, bottom = F.get("ys", F.lit(0)), F.element_at("ys", -1)
    inside = F.col("w.x0").between(F.col("x0") - SIDE_PAD, F.col("x1") + SIDE_PAD) & F.col("w.y").between(top - TOP_PAD, bottom + BOTTOM_PAD)
    found = regions.join(_words(words), PAGE).filter(inside).groupBy(*regions.columns).agg(_collected().alias("_w")).filter(F.size("_w") >= LEAST_WORDS)
    return with_lines(found, _slack(size))


def slots_of_lines(regions: DataFrame) -> DataFrame:
    """doc_id, page, region, slots of rows with `lines`: columns parted by corridors of x that nearly all lines leave free between two words.

    Without any, the line of most words parts the columns. Rows without words are left out.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, a, b = line_arrays.slots(*line_arrays.column_bounds(line_arrays.lines_of_lists(batch.column(3)), CORRIDOR_SHARE, CORRIDOR_WIDTH, OUTER_PAD))
            slots = line_arrays.listed(at, pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(line_arrays.SLOTS.value_type)))
            made = pa.RecordBatch.from_arrays([*batch.columns[:3], slots], [*REGION, "slots"])
            yield made.filter(pa.array(np.diff(at) > 0))

    kinds = dict(regions.dtypes)
    own = F.filter("lines", lambda x: F.size(x["words"]) >= 0).cast(f"array<{LINE}>")
    return regions.select(*REGION, own.alias("lines")).mapInArrow(part, ", ".join(f"{c} {kinds[c]}" for c in REGION) + ", slots array<struct<a:double,b:double>>")


def with_lines(words: DataFrame, slack: float) -> DataFrame:
    """words with `_w` (y, x0, x1, t), sorted, as its last column: the lines of these in its place, as lines_of makes them."""
    names = words.columns[:-1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], line_arrays.as_lists(line_arrays.lines_of_words(batch.columns[-1], slack))], [*names, "lines"])

    kinds = dict(words.dtypes)
    return words.mapInArrow(part, ", ".join(f"{c} {kinds[c]}" for c in names) + f", lines array<{LINE}>")


def header_rows(lines: Column, slots: Column) -> Column:
    """Header lines as rows of cells: without wide cells one row; else wide cells of one range joined, with the narrow ones that they cover, then the lines without wide cells."""
    by_start = lambda p, q: F.when(p["start"] < q["start"], -1).when(p["start"] > q["start"], 1).otherwise(0)
    is_wide = lambda c: c["span"] >= 2
    joined = lambda cells: F.array_join(F.transform(cells, lambda c: c["text"]), " ")
    range_of = lambda c: F.struct(c["start"].alias("start"), c["span"].alias("span"))
    under = lambda c, h: (c["start"] >= h["start"]) & (c["start"] < h["start"] + h["span"])

    def full(wide: Column, narrow: Column, r: Column) -> Column:
        own = joined(F.filter(wide, lambda c: range_of(c) == r))
        more = lambda text: joined(F.filter(narrow, lambda c: under(c, r) & ~text.contains(c["text"])))
        return F.struct(grids.let(own, lambda text: F.concat_ws(" ", text, F.nullif(more(text), F.lit("")))).alias("text"), r["start"].alias("start"), r["span"].alias("span"))

    def top(over: Column) -> Column:
        rest = lambda narrow, ranges: F.filter(narrow, lambda c: ~F.exists(ranges, lambda r: under(c, r)))
        put = lambda wide, narrow, ranges: F.concat(F.transform(ranges, lambda r: full(wide, narrow, r)).cast(CELLS), rest(narrow, ranges).cast(CELLS))
        parts = lambda wide: grids.let(F.filter(over, lambda c: ~is_wide(c)), lambda narrow: grids.let(F.array_distinct(F.transform(wide, range_of)), lambda ranges: put(wide, narrow, ranges)))
        return F.array_sort(grids.let(F.filter(over, is_wide), parts), by_start)

    def rows(per_line: Column) -> Column:
        plain = F.transform(F.filter(per_line, lambda r: ~F.exists(r, is_wide)), lambda r: F.array_sort(r, by_start)).cast(f"array<{CELLS}>")
        return F.concat(F.array(grids.let(F.flatten(F.filter(per_line, lambda r: F.exists(r, is_wide))), top)), plain)

    merged = F.when(F.size(lines) > 0, F.array(grids.merged_row(lines, slots).cast(CELLS))).otherwise(F.array().cast(f"array<{CELLS}>"))
    per_line = F.transform(lines, lambda x: grids.cells_of_line(x["words"], slots))
    return grids.let(per_line, lambda cells: F.when(F.exists(F.flatten(cells), is_wide), rows(cells)).otherwise(merged))


def _raw_kind(text: Column) -> Column:
    t = normal(text)
    return F.when(t.rlike(r"(?i)^(table|表) ?[0-9]+ ?[:：.]"), "table").when(t.rlike(r"(?i)^(figure|fig\.?|图) ?[0-9]+ ?[:：.]"), "figure")


def _numbered(captions: DataFrame) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "text"))
    return captions.select(*PAGE, order.alias("caption"), "text", *BOX)


def with_captions(boxes: DataFrame, captions: DataFrame, *keys: str) -> DataFrame:
    """boxes (keys, x0, x1, y0, y1) with `_caption` (text, kind, box) of the lowest caption within reach above or below."""
    c = captions.select(*PAGE, F.struct(F.col("y0").alias("_cy"), F.col("caption").alias("_n"), normal("text").alias("text"), _raw_kind(F.col("text")).alias("kind"), "x0", "x1", "y0", "y1").alias("_c"))
    near = F.col("_c.y0").between(F.col("y0") - CAPTION_REACH, F.col("y0") + CAPTION_SLACK) | F.col("_c.y0").between(F.col("y1") - CAPTION_SLACK, F.col("y1") + CAPTION_REACH)
    j = boxes.select(*keys, *BOX).join(c, PAGE).filter(near & (F.col("_c.x1") >= F.col("x0")) & (F.col("_c.x0") <= F.col("x1")))
    return boxes.join(j.groupBy(*keys).agg(F.max("_c").alias("_caption")), list(keys), "left")


def region_tables(regions: DataFrame, size: float = 10.0) -> DataFrame:
    """Regions with lines and ys as grids: columns, head_rows and rows (text, span), rows without text left out; under two rows is no table."""
    r = regions.withColumn("lines", grids.without_captions(F.col("lines"))).filter(F.size("lines") > 0)
    middle = F.get("ys", F.lit(1)) - 1.0
    r = r.withColumns({"_head": F.filter("lines", lambda x: x["y"] < middle), "_body": F.filter("lines", lambda x: x["y"] >= middle)})
    measured = r.select(*REGION, F.when(F.size("_body") > 0, F.col("_body")).otherwise(F.col("lines")).alias("lines"))
    r = r.join(slots_of_lines(measured), REGION)
    body = F.transform(grids.logical_rows(F.col("_body"), F.lit(size)), lambda x: grids.merged_row(x, F.col("slots")).cast(CELLS))
    marked = lambda rows, head: F.transform(rows, lambda c: F.struct(F.lit(head).alias("head"), c.alias("cells")))
    r = r.withColumn("_rows", F.filter(F.concat(marked(header_rows(F.col("_head"), F.col("slots")), True), marked(body, False)), lambda x: F.exists(x["cells"], lambda c: normal(c["text"]) != "")))
    r = stored(r, "table_rows")
    columns = F.size("slots")
    return r.filter(F.size("_rows") >= 2).select(*regions.drop("lines").columns, columns.alias("columns"), F.size(F.filter("_rows", lambda x: x["head"])).alias("head_rows"), grids.grid(F.transform("_rows", lambda x: x["cells"]), columns).alias("rows"))


def boxed_tables(drawings: DataFrame, words: DataFrame, size: float = 10.0, tolerance: float = 1.0) -> DataFrame:
    """Tables whose cells are boxes: doc_id, page, region, x0, x1, y0, y1, columns, head_rows = 1, rows (text, span).

    Thin drawings are lines, others four edges; pieces on one line are joined. Where a horizontal and a vertical line
    cross is a corner. A cell runs from a corner that goes right and down to the nearest corner on the right that
    goes down and the nearest below that goes right, if these lead to a fourth. Lines that cross belong to one table. A
    wide cell's text stands in its first place, null under it, also in the rows that it spans. Rows without text are left
    out, and tables of under two rows.

    Drawings and words of a page meet in a row, tables of many pages are found at once by arrays.
    """
    numbers = F.struct(*[F.col(c).cast("double").alias(c) for c in BOX])
    d = drawings.dropna(subset=BOX).groupBy(*PAGE).agg(F.collect_list(numbers).alias("_d"))
    w = _words(words.dropna(subset=["x0", "x1", "y"])).groupBy(*PAGE).agg(_collected().alias("_w"))
    names = [*REGION, *BOX, "columns", "head_rows", "rows"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, columns = box_arrays.tables(batch.column(2), batch.column(3), tolerance, _slack(size))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(page)) for c in batch.columns[:2]), *columns], names)

    kinds = dict(drawings.dtypes)
    rest = ", ".join(f"{c} double" for c in BOX) + ", columns int, head_rows int, rows array<array<struct<text:string,span:int>>>"
    return d.join(w, PAGE).select(*PAGE, "_d", "_w").mapInArrow(part, f"doc_id {kinds['doc_id']}, page {kinds['page']}, region int, {rest}")


def _apart(boxes: DataFrame, others: DataFrame, *keys: str, before: Column | None = None) -> DataFrame:
    """boxes that share no area with one of the others of their page (that `before` holds for)."""
    o = others.select(*[F.col(c).alias(f"_{c}") for c in others.columns])
    same = (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page"))
    shared = (F.col("x1") > F.col("_x0")) & (F.col("_x1") > F.col("x0")) & (F.col("y1") > F.col("_y0")) & (F.col("_y1") > F.col("y0"))
    return boxes.join(o, same & shared & (F.lit(True) if before is None else before), "left_anti")


def grown_areas(areas: DataFrame, blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """Areas (doc_id, page, caption, x0, x1, top, bottom) that reach up over the labels right above them, until nothing moves.

    A label within GROW_GAP over the top (it may reach GROW_SLACK into it) moves the top to its own; captions and
    sentences are no labels. Labels count in the order of their blocks, over and over. The area ends GROW_REACH up
    or at a caption above.
    """
    key = [*PAGE, "caption"]
    over = captions.select(*PAGE, F.col("y1").alias("_cy"))
    ceiling = F.greatest(F.col("top") - GROW_REACH, F.max(F.when(F.col("_cy") < F.col("top"), F.col("_cy"))))
    a = areas.join(areas.select(*key, "top").join(over, PAGE, "left").groupBy(*key, "top").agg(ceiling.alias("_ceiling")).drop("top"), key)
    b = blocks.filter(figure_label(F.col("text")) & caption_kind(F.col("text")).isNull()).select(*PAGE, F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.struct("block", F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1")).alias("_b"))
    near = (F.col("_x1") >= F.col("x0")) & (F.col("_x0") <= F.col("x1")) & (F.col("_b.y1") <= F.col("top") + GROW_SLACK) & (F.col("_b.y1") >= F.col("_ceiling"))
    found = a.join(b, PAGE).filter(near).groupBy(*key).agg(F.sort_array(F.collect_list("_b")).alias("_labels"))
    moves = lambda t, b: F.when((b["y1"] <= t + GROW_SLACK) & (t - b["y1"] <= GROW_GAP) & (b["y0"] < t), b["y0"]).otherwise(t)
    once = lambda t: F.aggregate("_labels", t, moves)
    # each pass takes a label in, or nothing moves any more
    top = F.aggregate("_labels", F.col("top").cast("double"), lambda t, _: once(t))
    return a.join(found, key, "left").withColumn("top", F.coalesce(top, F.col("top").cast("double"))).select(*areas.columns)


def figure_regions(captions: DataFrame, regions: DataFrame, drawings: DataFrame) -> DataFrame:
    """Numbered captions of figures with their areas: the first region that ends within reach above, else the drawings over the caption."""
    c = captions.filter(_raw_kind(F.col("text")) == "figure")
    r = regions.select(*PAGE, "region", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.get("ys", F.lit(0)).alias("_top"), F.element_at("ys", -1).alias("_bottom"))
    fits = (F.col("_bottom") < F.col("y0") - 2) & (F.col("y0") - F.col("_bottom") <= CAPTION_REACH) & (F.col("_x1") >= F.col("x0")) & (F.col("_x0") <= F.col("x1"))
    first = c.join(r, PAGE).filter(fits).groupBy(*PAGE, "caption").agg(F.min_by(F.struct("_x0", "_x1", "_top"), F.col("region")).alias("_r"))
    drawn = figure_areas(captions.select(*PAGE, "caption", *BOX), drawings).select(*PAGE, "caption", F.struct(F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("top").alias("_top")).alias("_d"))
    j = c.join(first, [*PAGE, "caption"], "left").join(drawn, [*PAGE, "caption"], "left").withColumn("_a", F.coalesce("_r", "_d"))
    return j.select(*PAGE, "caption", F.col("_a._x0").alias("x0"), F.col("_a._x1").alias("x1"), F.col("_a._top").alias("top"), (F.col("y0") - 2).alias("bottom"))



def page_blocks(words: DataFrame, drawings: DataFrame, captions: DataFrame, blocks: DataFrame, size: float = 10.0) -> DataFrame:
    """What stands on each page besides running text: doc_id, page, number, kind, x0, x1, y0, y1, columns, head_rows, rows, lines, content, caption.

    Regions between rules are algorithms first (lines with their indents), then figures by their caption, then tables, if
    a caption says so or they look like one. Boxed tables that share no area with these and no figure's caption follow,
    then figures: captions outside all of these, with their areas and the texts in them. Numbers count from 1 by (y0, x0).
    """
    captions = _numbered(captions)
    regions = table_regions(grids.rules(drawings), words)
    full = region_lines(regions, words, size).withColumns({"y0": F.get("ys", F.lit(0)), "y1": F.element_at("ys", -1)})
    texts = F.transform("lines", text_of)
    full = stored(full, "regions")
    full = full.withColumn("_code", (pseudocode_score(texts) >= PSEUDOCODE_SCORE) & (F.size("lines") >= PSEUDOCODE_LINES))
    starts = F.transform("lines", lambda x: F.struct(F.get(x["words"], F.lit(0))["x0"].alias("x0"), text_of(x).alias("text")))
    algorithms = full.filter("_code").select(*PAGE, F.lit("algorithm").alias("kind"), *BOX, structured.indented(starts, size).alias("lines"))
    rest = with_captions(full.filter("NOT _code").drop("_code"), captions, *REGION)
    kind = F.col("_caption.kind")
    tables = region_tables(rest.filter(kind.isNull() | (kind != "figure")), size)
    tables = tables.filter((F.coalesce(kind, F.lit("")) == "table") | structured.looks_like_table(F.col("rows"), F.col("columns")))
    tables = tables.select(*PAGE, F.lit("table").alias("kind"), *BOX, "columns", "head_rows", "rows", F.when(kind == "table", F.col("_caption.text")).otherwise("").alias("caption"))
    tables = stored(tables, "tables")
    boxed = stored(with_captions(boxed_tables(drawings, words, size), captions, *REGION).filter(kind.isNull() | (kind != "figure")).drop("_caption"), "boxed")
    claimed = algorithms.select(*PAGE, *BOX).unionByName(tables.select(*PAGE, *BOX))
    boxed = _apart(_apart(boxed, claimed), boxed.select(*REGION, *BOX), before=F.col("_region") < F.col("region"))
    boxed = boxed.select(*PAGE, F.lit("table").alias("kind"), *BOX, "columns", "head_rows", "rows", F.lit("").alias("caption"))
    claimed = claimed.unionByName(boxed.select(*PAGE, *BOX))
    areas = grown_areas(figure_regions(captions, regions, drawings), blocks, captions)
    free = _apart(captions, claimed).select(*PAGE, "caption", "text", F.col("y1").alias("_y1"))
    inside = F.col("w.x0").between(F.col("x0") - SIDE_PAD, F.col("x1") + SIDE_PAD) & F.col("w.y").between(F.col("top"), F.col("bottom") - 4)
    content = areas.join(_words(words), PAGE).filter(inside).groupBy(*PAGE, "caption").agg(grids.figure_text(lines_of(_collected(), _slack(size))).alias("content"))
    figures = areas.join(free, [*PAGE, "caption"]).join(content, [*PAGE, "caption"], "left")
    figures = figures.select(*PAGE, F.lit("figure").alias("kind"), "x0", "x1", F.col("top").alias("y0"), F.col("_y1").alias("y1"), F.coalesce("content", F.array().cast("array<string>")).alias("content"), F.col("text").alias("caption"))
    out = algorithms
    for more in (tables, boxed, figures):
        out = out.unionByName(more, allowMissingColumns=True)
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "kind"))
    return out.withColumn("number", order).select(*PAGE, "number", "kind", *BOX, "columns", "head_rows", "rows", "lines", "content", "caption")
